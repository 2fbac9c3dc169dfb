"""Catalogue: levels, viewports, tiles and request logs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.functions import to_level, to_slide, to_wsi
from slidelake.operators import levels as L
from slidelake.operators import regions as R
from slidelake.operators import viewport as V
from slidelake.operators.skew import shuffled
from slidelake.plans.bridge import PIXEL_TILE, Bridge, oracle
from slidelake.plans.pipelines import serve_viewports
from slidelake.plans.registry import query

TILE = ["slide_id", "level", "col", "row"]
ROW = '"row"'


@query("v01_level_for_scale", oracle("SELECT viewport_id, level, downsample FROM b_leveled", "b_leveled"))
def _(b: Bridge) -> DataFrame:
    return L.level_for_scale(b.viewports, b.levels).select("viewport_id", "level_info.level", "level_info.downsample")


@query("v02_level_for_mpp", oracle("""
    SELECT o.o_orderkey AS request_id,
           coalesce(arg_max(l.level, l.mpp) FILTER (WHERE l.mpp <= o.o_totalprice / 100000),
                    arg_min(l.level, l.mpp)) AS level
    FROM orders o JOIN b_levels_mpp l ON l.slide_id = o.o_custkey GROUP BY o.o_orderkey, o.o_totalprice""", "b_levels_mpp"))
def _(b: Bridge) -> DataFrame:
    requests = b.table("orders").selectExpr(
        "o_orderkey AS request_id", "o_custkey AS slide_id", "o_totalprice / 100000 AS target_mpp"
    )
    return L.level_for_mpp(requests, b.levels_mpp).select("request_id", "level_info.level")


@query("v03_level_info", oracle("""
    SELECT seq, r.level, coalesce(downsample, 1) AS downsample, coalesce(cols, 0) AS cols, coalesce("rows", 0) AS "rows"
    FROM b_requests r LEFT JOIN b_levels l ON l.slide_id = r.slide_id AND l.level = r.level""", "b_requests", "b_levels"))
def _(b: Bridge) -> DataFrame:
    return L.level_info(b.requests, b.levels, "default").select("seq", "level", "downsample", "cols", "rows")


@query("v04_visible_tiles", oracle(f"SELECT viewport_id, slide_id, level, col, {ROW} FROM b_visible", "b_visible"))
def _(b: Bridge) -> DataFrame:
    return V.visible_tiles(b.viewports, b.levels).select("viewport_id", *TILE)


def _rect(table: str, x: str, y: str, w: str, h: str, extra: str = "viewport_id, slide_id") -> str:
    """Checking SQL of the floor/ceil tile range of a rectangle."""
    side = "(tile_size * downsample)"
    return f"""
        SELECT {extra}, level, CAST(c AS INTEGER) AS col, CAST(r AS INTEGER) AS "row"
        FROM (SELECT *, unnest(range(CAST(greatest(0, floor(({x}) / {side})) AS BIGINT),
                                     CAST(least(cols, ceil((({x}) + ({w})) / {side})) AS BIGINT))) AS c FROM {table}),
             LATERAL (SELECT unnest(range(CAST(greatest(0, floor(({y}) / {side})) AS BIGINT),
                                          CAST(least("rows", ceil((({y}) + ({h})) / {side})) AS BIGINT))) AS r)"""


@query("v04_visible_tiles_scheduler", oracle(_rect("b_leveled", "x", "y", "width", "height"), "b_leveled"))
def _(b: Bridge) -> DataFrame:
    return V.visible_tiles(b.viewports, b.levels, "ceil").select("viewport_id", *TILE)


@query("v05_tile_position", oracle("""
    SELECT g.slide_id, g.level, g.col, g."row",
           CAST(g.col * l.tile_size * l.downsample AS BIGINT) AS x, CAST(g."row" * l.tile_size * l.downsample AS BIGINT) AS y,
           CAST(greatest(0, least(l.tile_size * l.downsample, s.width - g.col * l.tile_size * l.downsample)) AS BIGINT) AS width,
           CAST(greatest(0, least(l.tile_size * l.downsample, s.height - g."row" * l.tile_size * l.downsample)) AS BIGINT) AS height
    FROM b_grid g JOIN b_levels l USING (slide_id, level) JOIN b_slides s USING (slide_id)""", "b_grid", "b_levels", "b_slides"))
def _(b: Bridge) -> DataFrame:
    return V.tile_position(b.tile_index.drop("length"), b.slides, b.levels)


@query("v06_tile_bounds", oracle("""
    SELECT g.slide_id, g.level, g.col, g."row",
           CAST(g.col * l.tile_size * l.downsample AS DOUBLE) AS x, CAST(g."row" * l.tile_size * l.downsample AS DOUBLE) AS y,
           CAST(l.tile_size * l.downsample AS DOUBLE) AS width, CAST(l.tile_size * l.downsample AS DOUBLE) AS height
    FROM b_grid g JOIN b_levels l USING (slide_id, level)""", "b_grid", "b_levels"))
def _(b: Bridge) -> DataFrame:
    return V.tile_bounds(b.tile_index.drop("length"), b.levels)


@query("v07_transforms", oracle("""
    SELECT viewport_id, round(x / downsample, 6) AS level_x, round(x / downsample * downsample, 6) AS slide_x,
           round(x * CASE WHEN source_mpp > 0 THEN target_mpp / source_mpp ELSE 1 END, 6) AS wsi_x
    FROM b_leveled JOIN (SELECT slide_id, source_mpp, target_mpp FROM b_slides) USING (slide_id)""", "b_leveled", "b_slides"))
def _(b: Bridge) -> DataFrame:
    leveled = L.level_for_scale(b.viewports, b.levels).join(
        shuffled(b.slides.select("slide_id", "source_mpp", "target_mpp")), "slide_id"
    )
    ds, x = F.col("level_info.downsample"), F.col("x")
    return leveled.select(
        "viewport_id",
        F.round(to_level(x, ds), 6).alias("level_x"),
        F.round(to_slide(to_level(x, ds), ds), 6).alias("slide_x"),
        F.round(to_wsi(x, F.col("target_mpp"), F.col("source_mpp")), 6).alias("wsi_x"),
    )


@query("v08_tiles_in_roi", oracle("""
    SELECT b.seq AS roi_id, t.slide_id, t.level, t.col, t."row", t.length
    FROM b_boxes b JOIN b_levels l ON l.slide_id = b.slide_id AND l.downsample = 1
    JOIN b_index t ON t.slide_id = l.slide_id AND t.level = l.level AND t.length > 0
     AND NOT (t.col * 512 + 512 <= b.x0 OR t.col * 512 >= b.x0 + b.w + 300
              OR t."row" * 512 + 512 <= b.y0 OR t."row" * 512 >= b.y0 + b.h + 300)""", "b_boxes", "b_levels", "b_index"))
def _(b: Bridge) -> DataFrame:
    finest = b.levels.filter("downsample = 1").select("slide_id", "level")
    rois = b.annotations.selectExpr(
        "seq AS roi_id", "slide_id", "x0 AS x", "y0 AS y", "w + 300 AS w", "h + 300 AS h"
    ).join(finest, "slide_id")
    return R.tiles_in_roi(b.tile_index.filter("length > 0"), rois, b.levels).select("roi_id", *TILE, "length")


@query("v09_get_tiles", oracle("""
    SELECT r.seq, r.slide_id, r.level, r.col, r.row_ AS "row", t.length
    FROM b_requests r LEFT JOIN (SELECT * FROM b_index WHERE length > 0) t
      ON t.slide_id = r.slide_id AND t.level = r.level AND t.col = r.col AND t."row" = r.row_""", "b_requests", "b_index"))
def _(b: Bridge) -> DataFrame:
    return R.get_tiles(b.requests.select("seq", *TILE), b.tile_index).select("seq", *TILE, "length")


@query("v10_assemble_regions", oracle("""
    SELECT q.request_id, CAST(q.w AS INTEGER) AS width, CAST(q.h AS INTEGER) AS height,
           CAST(255 * q.w * q.h + coalesce(sum(p.r - 255), 0) AS BIGINT) AS sum_r,
           CAST(255 * q.w * q.h + coalesce(sum(p.g - 255), 0) AS BIGINT) AS sum_g,
           CAST(255 * q.w * q.h + coalesce(sum(p.b - 255), 0) AS BIGINT) AS sum_b,
           CAST(1530 * q.h * (q.w * (q.w + 1) // 2) + coalesce(sum((p.x - q.x + 1) * (p.r + 2 * p.g + 3 * p.b - 1530)), 0) AS BIGINT) AS sum_x,
           CAST(1530 * q.w * (q.h * (q.h + 1) // 2) + coalesce(sum((p.y - q.y + 1) * (p.r + 2 * p.g + 3 * p.b - 1530)), 0) AS BIGINT) AS sum_y
    FROM (SELECT p_partkey AS request_id, p_partkey % 7 AS slide_id, p_partkey % 40 - 5 AS x, p_partkey % 31 - 4 AS y,
                 10 + p_size AS w, 7 + p_size % 20 AS h FROM part) q
    LEFT JOIN b_pixels p ON p.slide_id = q.slide_id AND p.x >= q.x AND p.x < q.x + q.w AND p.y >= q.y AND p.y < q.y + q.h
    GROUP BY q.request_id, q.w, q.h""", "b_pixels"))
def _(b: Bridge) -> DataFrame:
    requests = b.table("part").selectExpr(
        "p_partkey AS request_id", "p_partkey % 7 AS slide_id", "4 AS level", "p_partkey % 40 - 5 AS x",
        "p_partkey % 31 - 4 AS y", "CAST(10 + p_size AS INT) AS w", "CAST(7 + p_size % 20 AS INT) AS h",
    )
    return pixel_sums(R.assemble_regions(requests, b.pixel_tiles, PIXEL_TILE))


def pixel_sums(images: DataFrame) -> DataFrame:
    """Channel sums of raw RGB rows, and sums weighted by place, which tell a turned or shuffled image."""
    keys = [c for c in images.columns if c not in ("rgb", "block", "y_offset")]
    names = [*keys, "sum_r", "sum_g", "sum_b", "sum_x", "sum_y"]

    def sums(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                height, width = row[at["height"]], row[at["width"]]
                px = np.frombuffer(row[-1], np.uint8).reshape(height, width, 3).astype(np.int64)
                mixed = px @ np.array([1, 2, 3])
                by_x = int(mixed.sum(axis=0) @ np.arange(1, width + 1))
                by_y = int(mixed.sum(axis=1) @ np.arange(1, height + 1))
                out.append((*row[:-1], *px.sum(axis=(0, 1)).tolist(), by_x, by_y))
            yield pd.DataFrame(out, columns=names)

    at = {k: i for i, k in enumerate(keys)}
    fields = [f"`{k}` {images.schema[k].dataType.simpleString()}" for k in keys] + [f"{n} bigint" for n in names[len(keys):]]
    return images.select(*keys, "rgb").mapInPandas(sums, ", ".join(fields))


def place_sums(x: str, y: str) -> str:
    """Checking SQL of the weighted sums; ``x`` and ``y`` count from 0 inside an image with channels r, g, b."""
    return f"sum(({x} + 1) * (r + 2 * g + 3 * b))::BIGINT AS sum_x, sum(({y} + 1) * (r + 2 * g + 3 * b))::BIGINT AS sum_y"


@query("v11_resolve_regions", oracle("""
    SELECT b.seq AS roi_id, l.level, l.downsample,
           CAST(trunc(b.x0 / l.downsample) AS INTEGER) AS level_x, CAST(trunc(b.y0 / l.downsample) AS INTEGER) AS level_y,
           CAST(trunc((b.w + 300) / l.downsample) AS INTEGER) AS level_w, CAST(trunc((b.h + 300) / l.downsample) AS INTEGER) AS level_h,
           l.mpp > 0.75 AS degraded
    FROM b_boxes b JOIN (SELECT slide_id, coalesce(arg_max(level, mpp) FILTER (WHERE mpp <= 0.5), arg_min(level, mpp)) AS level
                         FROM b_levels_mpp GROUP BY slide_id) p USING (slide_id)
    JOIN b_levels_mpp l ON l.slide_id = p.slide_id AND l.level = p.level""", "b_boxes", "b_levels_mpp"))
def _(b: Bridge) -> DataFrame:
    rois = b.annotations.selectExpr("seq AS roi_id", "slide_id", "x0 AS x", "y0 AS y", "w + 300 AS w", "h + 300 AS h")
    return L.resolve_regions(rois, b.levels_mpp, 0.5).select(
        "roi_id", "level", "downsample", "level_x", "level_y", "level_w", "level_h", "degraded"
    )


@query("v12_needs_original", oracle("""
    SELECT slide_id, 0.75 < target_mpp OR 0.6 < target_mpp AS needs_original FROM b_slides""", "b_slides"))
def _(b: Bridge) -> DataFrame:
    return L.needs_original(b.slides, 0.75, 0.6).select("slide_id", "needs_original")


_EXT = """
    SELECT *, x - 512 + least(rx, 0) AS ext_x, y - 512 + least(ry, 0) AS ext_y,
           width + 1024 + abs(rx) AS ext_width, height + 1024 + abs(ry) AS ext_height
    FROM (SELECT *, CASE WHEN abs(velocity_x) > 50 THEN sign(velocity_x) * 1024 ELSE 0 END AS rx,
                    CASE WHEN abs(velocity_y) > 50 THEN sign(velocity_y) * 1024 ELSE 0 END AS ry FROM b_leveled)"""


@query("v13_extend_viewport", oracle(f"""
    SELECT viewport_id, CAST(ext_x AS DOUBLE) AS ext_x, CAST(ext_y AS DOUBLE) AS ext_y,
           CAST(ext_width AS DOUBLE) AS ext_width, CAST(ext_height AS DOUBLE) AS ext_height FROM ({_EXT})""", "b_leveled"))
def _(b: Bridge) -> DataFrame:
    return V.extend_viewport(L.level_for_scale(b.viewports, b.levels)).select(
        "viewport_id", "ext_x", "ext_y", "ext_width", "ext_height"
    )


_AREAS = f"""
    ext AS ({_EXT}),
    nb AS (SELECT e.viewport_id, e.slide_id, e.x, e.y, e.width, e.height, l.level - e.level AS step,
                  l.level, l.downsample, l.cols, l."rows", l.tile_size
           FROM ext e JOIN b_levels l ON l.slide_id = e.slide_id AND abs(l.level - e.level) = 1),
    areas AS (
        SELECT 0 AS priority, * FROM ({_rect('ext', 'x', 'y', 'width', 'height')})
        UNION ALL SELECT 1, * FROM ({_rect('ext', 'ext_x', 'ext_y', 'ext_width', 'ext_height')})
        UNION ALL SELECT 2, * FROM ({_rect('(SELECT * FROM nb WHERE step = 1)', 'x', 'y', 'width', 'height')})
        UNION ALL SELECT 3, * FROM ({_rect('(SELECT * FROM nb WHERE step = -1)', 'x + width / 2 - width / 8', 'y + height / 2 - height / 8', 'width / 4', 'height / 4')})),
    ranked AS (SELECT viewport_id, slide_id, level, col, "row", min(priority) AS priority FROM areas a
               WHERE NOT EXISTS (SELECT 1 FROM b_cached c WHERE c.slide_id = a.slide_id AND c.level = a.level AND c.col = a.col AND c."row" = a."row")
               GROUP BY ALL)"""


def _with_areas(select: str) -> str:
    return oracle("SELECT 0", "b_leveled", "b_cached").rsplit("\nSELECT 0", 1)[0] + ",\n" + _AREAS + "\n" + select


@query("v14_rank_prefetch", _with_areas('SELECT viewport_id, slide_id, level, col, "row", priority FROM ranked'))
def _(b: Bridge) -> DataFrame:
    return V.rank_prefetch(b.viewports, b.levels, b.cached)


@query("v15_budget_prefetch", _with_areas("""
    SELECT viewport_id, slide_id, level, col, "row", priority, CAST(rank AS INTEGER) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY viewport_id ORDER BY priority, "row", col) AS rank,
               count(*) FILTER (WHERE priority = 0) OVER (PARTITION BY viewport_id) AS visible FROM ranked)
    WHERE rank <= least(visible, 256) + greatest(0, 32 - least(visible, 256))"""))
def _(b: Bridge) -> DataFrame:
    return V.budget_prefetch(V.rank_prefetch(b.viewports, b.levels, b.cached))


@query("v16_warmup_tiles", oracle("""
    SELECT g.slide_id, g.level, g.col, g."row" FROM b_grid g JOIN b_levels l USING (slide_id, level)
    WHERE l.cols * l."rows" <= 64""", "b_grid", "b_levels"))
def _(b: Bridge) -> DataFrame:
    return V.warmup_tiles(b.levels)


@query("v18_preload_worklist", oracle("""
    SELECT g.* FROM b_grid g ANTI JOIN supplier ON s_suppkey = g.slide_id
    ANTI JOIN b_cached c ON c.slide_id = g.slide_id AND c.level = g.level AND c.col = g.col AND c."row" = g."row" """,
    "b_grid", "b_cached"))
def _(b: Bridge) -> DataFrame:
    unreadable = b.table("supplier").selectExpr("s_suppkey AS slide_id")
    return V.preload_worklist(b.levels, b.cached, unreadable)


@query("v18_preload_counts", oracle("""
    SELECT g.slide_id, count(*) FILTER (WHERE c.slide_id IS NULL AND i.length > 0) AS loaded,
           count(*) FILTER (WHERE c.slide_id IS NULL AND i.length = 0) AS failed,
           count(*) FILTER (WHERE c.slide_id IS NOT NULL) AS skipped
    FROM b_grid g JOIN b_index i USING (slide_id, level, col, "row") LEFT JOIN b_cached c USING (slide_id, level, col, "row")
    WHERE g.slide_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY g.slide_id""", "b_index", "b_cached", "b_grid"))
def _(b: Bridge) -> DataFrame:
    unreadable = b.table("supplier").selectExpr("s_suppkey AS slide_id")
    return V.preload_counts(b.levels, b.cached, b.tile_index, unreadable)


@query("v19_filter_cached", oracle("""
    SELECT viewport_id, slide_id, level, col, "row" FROM (
        SELECT v.*, c.slide_id IS NOT NULL AS hit,
               count(c.slide_id) OVER (PARTITION BY viewport_id) AS hits, count(*) OVER (PARTITION BY viewport_id) AS n
        FROM b_visible v LEFT JOIN b_cached c USING (slide_id, level, col, "row"))
    WHERE hit OR hits < n * CAST(0.3 AS DOUBLE)""", "b_visible", "b_cached"))
def _(b: Bridge) -> DataFrame:
    return V.filter_cached(V.visible_tiles(b.viewports, b.levels), b.cached).select("viewport_id", *TILE)


@query("v20_cache_stats", oracle("""
    SELECT tier, a.hits, a.misses, t.tiles, CAST(t.bytes AS BIGINT) AS bytes, round(a.hits / (a.hits + a.misses), 6) AS hit_ratio
    FROM (SELECT tier, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses FROM b_requests GROUP BY tier) a
    JOIN (SELECT tier, count(*) AS tiles, sum(bytes) AS bytes FROM
            (SELECT tier, slide_id, level, col, row_, max(bytes) AS bytes FROM b_requests GROUP BY ALL) GROUP BY tier) t USING (tier)""", "b_requests"))
def _(b: Bridge) -> DataFrame:
    return V.cache_stats(b.requests).withColumn("hit_ratio", F.round("hit_ratio", 6))


@query("v21_tileset_changes", oracle("""
    SELECT viewer_id, seq, level, n_tiles, CASE WHEN prev_level <> level THEN prev_seq END AS fallback_seq FROM (
        SELECT *, lag(tiles) OVER w AS prev_tiles, lag(level) OVER w AS prev_level, lag(seq) OVER w AS prev_seq
        FROM (SELECT viewer_id, ts, seq, max(level) AS level, count(*) AS n_tiles,
                     list(concat(level, '/', col, '_', "row") ORDER BY level, col, "row") AS tiles
              FROM b_visible GROUP BY viewer_id, ts, seq)
        WINDOW w AS (PARTITION BY viewer_id ORDER BY ts, seq))
    WHERE prev_tiles IS DISTINCT FROM tiles""", "b_visible"))
def _(b: Bridge) -> DataFrame:
    return V.tileset_changes(V.visible_tiles(b.viewports, b.levels)).drop("ts")


@query("v22_pan_velocity", oracle("""
    SELECT seq, round(coalesce((x - lag(x) OVER w) / nullif((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 0) / nullif(scale, 0), 0), 6) AS velocity_x,
           round(coalesce((y - lag(y) OVER w) / nullif((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 0) / nullif(scale, 0), 0), 6) AS velocity_y
    FROM b_viewports WINDOW w AS (PARTITION BY viewer_id ORDER BY ts, seq)""", "b_viewports"))
def _(b: Bridge) -> DataFrame:
    positions = b.viewports.selectExpr("viewer_id", "ts", "seq", "x AS content_x", "y AS content_y", "scale")
    return V.pan_velocity(positions).select(
        "seq", F.round("velocity_x", 6).alias("velocity_x"), F.round("velocity_y", 6).alias("velocity_y")
    )


@query("v23_dedupe_requests", oracle("""
    SELECT slide_id, level, col, row_ AS "row", min(seq) AS seq, arg_min(viewer_id, seq) AS viewer_id FROM (
        SELECT *, max(generation) OVER (PARTITION BY viewer_id) AS newest FROM b_requests)
    WHERE generation = newest GROUP BY ALL""", "b_requests"))
def _(b: Bridge) -> DataFrame:
    return V.dedupe_requests(b.requests).select(*TILE, "seq", "viewer_id")


@query("serve_viewports", oracle("""
    SELECT v.viewport_id, v.slide_id, concat(v.level, '/', v.col, '_', v."row", '?g=0') AS url,
           CAST(v.col * 512 * l.downsample AS BIGINT) AS x, CAST(greatest(0, least(512 * l.downsample, s.width - v.col * 512 * l.downsample)) AS BIGINT) AS width
    FROM (SELECT v.*, c.slide_id IS NOT NULL AS hit,
                 count(c.slide_id) OVER (PARTITION BY viewport_id) AS hits, count(*) OVER (PARTITION BY viewport_id) AS n
          FROM b_visible v LEFT JOIN b_cached c USING (slide_id, level, col, "row")) v
    JOIN b_levels l USING (slide_id, level) JOIN b_slides s USING (slide_id)
    WHERE hit OR hits < n * CAST(0.3 AS DOUBLE)""", "b_visible", "b_cached", "b_levels", "b_slides"))
def _(b: Bridge) -> DataFrame:
    return serve_viewports(b.viewports, b.slides, b.levels, b.cached).select(
        "viewport_id", "slide_id", "url", "x", "width"
    )


@query("tiles_per_level", oracle(
    "SELECT slide_id, level, count(*) AS n_tiles, count(DISTINCT viewport_id) AS n_viewports FROM b_visible GROUP BY ALL", "b_visible"))
def tiles_per_level(b: Bridge) -> DataFrame:
    """Flagship: plan all slides, resolve all viewports, count tiles per slide and level."""
    tiles = V.visible_tiles(b.viewports, b.levels)
    # A viewport has one level, so its tiles are counted first and viewports add up.
    per_viewport = tiles.groupBy("slide_id", "level", "viewport_id").agg(F.count(F.lit(1)).alias("n"))
    return per_viewport.groupBy("slide_id", "level").agg(
        F.sum("n").alias("n_tiles"), F.count(F.lit(1)).alias("n_viewports")
    )
