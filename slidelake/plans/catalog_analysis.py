"""Catalogue: pixels, analyses and cell detection."""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.operators import analysis as G
from slidelake.operators import cells as C
from slidelake.operators import labelruns as R
from slidelake.operators import pixels as X
from slidelake.operators.components import label_components
from slidelake.operators.levels import with_level_mpp
from slidelake.operators.pyramid import pyramid_status
from slidelake.plans.bridge import PIXEL_HEIGHT, PIXEL_TILE, PIXEL_WIDTH, Bridge, oracle
from slidelake.plans.catalog_viewports import pixel_sums, place_sums
from slidelake.plans.pipelines import analyze_regions, build_job
from slidelake.plans.registry import query
from slidelake.session import cut_lineage, local_path, scratch_path
from slidelake.sources.files import pyramid_documents, pyramid_listing
from slidelake.sources.images import read_images
from slidelake.sources.packs import read_tile_index
from slidelake.sources.tilestore import write_tile_store

TILE = ["slide_id", "level", "col", "row"]
W, H, T = PIXEL_WIDTH, PIXEL_HEIGHT, PIXEL_TILE

# --- pixels ---------------------------------------------------------------


def _png(width: int, height: int, rgb: bytes) -> bytes:
    """Smallest valid PNG of raw RGB rows, to have image files to read."""
    chunk = lambda tag, data: struct.pack(">I", len(data)) + tag + data + struct.pack(">I", zlib.crc32(tag + data))
    rows = b"".join(b"\0" + rgb[y * width * 3:(y + 1) * width * 3] for y in range(height))
    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@query("s09_read_images", oracle("""
    SELECT concat(slide_id, '_', col, '_', "row", '.png') AS name, 8 AS width, 8 AS height,
           sum(r)::BIGINT AS sum_r, sum(g)::BIGINT AS sum_g, sum(b)::BIGINT AS sum_b, """ + place_sums("(x % 8)", "(y % 8)") + """ FROM b_pixels GROUP BY slide_id, col, "row" """, "b_pixels"))
def _(b: Bridge) -> DataFrame:
    root = scratch_path(b.spark, "images")
    base = local_path(root)

    def save(batches):
        os.makedirs(base, exist_ok=True)
        for pdf in batches:
            for t in pdf.itertuples(index=False):
                with open(f"{base}/{t.slide_id}_{t.col}_{t.row}.png", "wb") as out:
                    out.write(_png(t.width, t.height, t.rgb))
            yield pdf[["col"]]

    b.pixel_tiles.select("slide_id", "col", "row", "width", "height", "rgb").mapInPandas(save, "col int").write.format(
        "noop").mode("overwrite").save()
    images = read_images(b.spark, root)[0].withColumn("name", F.element_at(F.split("path", "/"), -1)).drop("path")
    return pixel_sums(images)


@query("s09_image_rejects", "SELECT concat(s_suppkey, '.png') AS name, 'not a readable image' AS reason FROM supplier WHERE s_suppkey % 3 = 0")
def _(b: Bridge) -> DataFrame:
    root = scratch_path(b.spark, "images")
    base = local_path(root)

    def save(batches):
        os.makedirs(base, exist_ok=True)
        for pdf in batches:
            for number in pdf["s_suppkey"]:
                with open(f"{base}/{number}.png", "wb") as out:
                    out.write(b"no image" if number % 3 == 0 else _png(1, 1, b"abc"))
            yield pdf

    b.table("supplier").select("s_suppkey").mapInPandas(save, "s_suppkey bigint").write.format("noop").mode("overwrite").save()
    return read_images(b.spark, root)[1].select(F.element_at(F.split("path", "/"), -1).alias("name"), "reason")


@query("p08_cut_tiles", oracle("""
    SELECT slide_id, 4 AS level, x // 20 AS col, y // 20 AS "row", CAST(max(x) - min(x) + 1 AS INTEGER) AS width,
           CAST(max(y) - min(y) + 1 AS INTEGER) AS height, sum(r)::BIGINT AS sum_r, sum(g)::BIGINT AS sum_g, sum(b)::BIGINT AS sum_b, """ + place_sums("(x % 20)", "(y % 20)") + """
    FROM (SELECT s.slide_id, q.x, q.y, coalesce(p.r, 255) AS r, coalesce(p.g, 255) AS g, coalesce(p.b, 255) AS b
          FROM (SELECT DISTINCT slide_id FROM b_pixels) s CROSS JOIN (SELECT unnest(range(96)) AS x) qx CROSS JOIN (SELECT unnest(range(72)) AS y) qy
          CROSS JOIN LATERAL (SELECT qx.x, qy.y) q LEFT JOIN b_pixels p ON p.slide_id = s.slide_id AND p.x = q.x AND p.y = q.y)
    GROUP BY slide_id, x // 20, y // 20""", "b_pixels"))
def _(b: Bridge) -> DataFrame:
    return pixel_sums(X.cut_tiles(_images(b), 20)).withColumns(
        {"col": F.col("col").cast("bigint"), "row": F.col("row").cast("bigint")}
    )


def _images(b: Bridge) -> DataFrame:
    """Whole images put together from the finest tiles."""
    from slidelake.operators.regions import assemble_regions

    whole = b.pixel_slides.selectExpr(
        "slide_id AS request_id", "slide_id", "4 AS level", "0 AS x", "0 AS y", "width AS w", "height AS h"
    )
    return assemble_regions(whole, b.pixel_tiles, T).selectExpr(
        "request_id AS slide_id", "4 AS level", "width", "height", "rgb"
    )


def _halving(level: int, width: int, height: int) -> str:
    """Checking SQL of one 2 x 2 step over the whole image; white where nothing is stored."""
    return f"""
    h{level} AS (SELECT slide_id, x // 2 AS x, y // 2 AS y,
        CAST(floor(avg(r) + 0.5) AS INTEGER) AS r, CAST(floor(avg(g) + 0.5) AS INTEGER) AS g, CAST(floor(avg(b) + 0.5) AS INTEGER) AS b,
        max(stored) AS stored FROM f{level + 1} GROUP BY slide_id, x // 2, y // 2),
    f{level} AS (SELECT slide_id, x, y, r, g, b, stored, max(stored) OVER (PARTITION BY slide_id, x // {T}, y // {T}) AS kept FROM h{level})"""


def _pyramid_sql() -> str:
    head = oracle("SELECT 0", "b_pixels").rsplit("\nSELECT 0", 1)[0]
    full = f"""
    f4 AS (SELECT s.slide_id, qx.x, qy.y, coalesce(p.r, 255) AS r, coalesce(p.g, 255) AS g, coalesce(p.b, 255) AS b,
                  CASE WHEN p.r IS NULL THEN 0 ELSE 1 END AS stored, CASE WHEN p.r IS NULL THEN 0 ELSE 1 END AS kept
           FROM (SELECT DISTINCT slide_id FROM b_pixels) s CROSS JOIN (SELECT unnest(range({W})) AS x) qx
           CROSS JOIN (SELECT unnest(range({H})) AS y) qy LEFT JOIN b_pixels p ON p.slide_id = s.slide_id AND p.x = qx.x AND p.y = qy.y)"""
    steps = ",".join(_halving(level, 0, 0) for level in (3, 2, 1, 0))
    union = " UNION ALL ".join(
        f'SELECT slide_id, {level} AS level, x // {T} AS col, y // {T} AS "row", * EXCLUDE (slide_id) FROM f{level} WHERE kept = 1' for level in range(5)
    )
    return f"""{head},\n{full},{steps}
    SELECT slide_id, level, CAST(col AS INTEGER) AS col, CAST("row" AS INTEGER) AS "row",
           CAST(max(x) - min(x) + 1 AS INTEGER) AS width, CAST(max(y) - min(y) + 1 AS INTEGER) AS height,
           sum(r)::BIGINT AS sum_r, sum(g)::BIGINT AS sum_g, sum(b)::BIGINT AS sum_b,
           {place_sums(f"(x % {T})", f"(y % {T})")} FROM ({union}) GROUP BY ALL"""


@query("p09_build_pyramid", _pyramid_sql())
def _(b: Bridge) -> DataFrame:
    return pixel_sums(X.build_pyramid_tiles(b.pixel_tiles, b.pixel_slides, b.pixel_levels))


def _filter_sql(kernel: str, factor: float, out_w: int, out_h: int) -> str:
    """Checking SQL of a separable filter on the white-filled image."""
    head = oracle("SELECT 0", "b_pixels").rsplit("\nSELECT 0", 1)[0]
    if kernel == "lanczos3":
        sinc = lambda x: f"(CASE WHEN abs({x}) < 1e-12 THEN 1 ELSE sin(pi() * ({x})) / (pi() * ({x})) END)"
        d = f"((s - ((t + 0.5) / {factor} - 0.5)) / {max(1 / factor, 1)})"
        weight = f"CASE WHEN abs({d}) < 3 THEN {sinc(d)} * {sinc(d + ' / 3')} ELSE 0 END"
    else:
        weight = f"greatest(0, least(s + 1, (t + 1) / {factor}) - greatest(s, t / {factor}))"

    def axis(name: str, size: int, out: int) -> str:
        return f"""{name} AS (SELECT t, s, w / sum(w) OVER (PARTITION BY t) AS w FROM (SELECT t, s, {weight} AS w
            FROM (SELECT unnest(range({size})) AS s) CROSS JOIN (SELECT unnest(range({out})) AS t)) WHERE w <> 0)"""

    return f"""{head}, {axis('wx', W, out_w)}, {axis('wy', H, out_h)},
    slides AS (SELECT DISTINCT slide_id FROM b_pixels),
    rows_done AS (SELECT p.slide_id, wx.t AS x, p.y, sum(wx.w * (p.r - 255)) AS r, sum(wx.w * (p.g - 255)) AS g, sum(wx.w * (p.b - 255)) AS b
                  FROM b_pixels p JOIN wx ON wx.s = p.x GROUP BY ALL),
    done AS (SELECT p.slide_id, p.x, wy.t AS y, sum(wy.w * p.r) AS r, sum(wy.w * p.g) AS g, sum(wy.w * p.b) AS b
             FROM rows_done p JOIN wy ON wy.s = p.y GROUP BY ALL),
    filled AS (SELECT s.slide_id, qx.x, qy.y, {', '.join(f"CAST(least(255, greatest(0, floor(255 + coalesce(d.{c}, 0) + 0.5 + 1e-9))) AS BIGINT) AS {c}" for c in 'rgb')}
               FROM slides s CROSS JOIN (SELECT unnest(range({out_w})) AS x) qx CROSS JOIN (SELECT unnest(range({out_h})) AS y) qy
               LEFT JOIN done d ON d.slide_id = s.slide_id AND d.x = qx.x AND d.y = qy.y)"""


@query("p10_resample_lanczos", _filter_sql("lanczos3", 0.5, 48, 36) + """
    SELECT slide_id, sum(r)::BIGINT AS sum_r, sum(g)::BIGINT AS sum_g, sum(b)::BIGINT AS sum_b, """ + place_sums("x", "y") + " FROM filled GROUP BY slide_id")
def _(b: Bridge) -> DataFrame:
    tiles = X.resample_to(b.pixel_tiles, b.pixel_slides, F.col("source_mpp") / 0.5, out_tile_size=16)
    # Output tiles that no stored tile reaches stay missing and count as white.
    covered = pixel_sums(tiles).withColumn("n", F.col("width") * F.col("height"))
    mixed = F.col("sum_r") + 2 * F.col("sum_g") + 3 * F.col("sum_b")

    def whole(name: str, index: str, side: str, across: str, out: int, out_across: int):
        """Weighted sum over the slide: tiles moved to their place, what is missing white."""
        moved = F.sum(F.col(f"sum_{name}") + 16 * F.col(index) * mixed)
        weight = F.col(across) * (F.col(side) * (F.col(side) + 1) / 2 + 16 * F.col(index) * F.col(side))
        return (moved + 1530 * (out_across * out * (out + 1) // 2 - F.sum(weight))).cast("bigint").alias(f"sum_{name}")

    return covered.groupBy("slide_id").agg(
        *[(F.sum(f"sum_{c}") + 255 * (48 * 36 - F.sum("n"))).alias(f"sum_{c}") for c in "rgb"],
        whole("x", "col", "width", "height", 48, 36), whole("y", "row", "height", "width", 36, 48),
    )


@query("p11_thumbnails", _filter_sql("box", 32 / 48, 32, 24).replace(f"range({W})", "range(48)").replace(f"range({H})", "range(36)")
       .replace("b_pixels p JOIN wx", "half p JOIN wx").replace("slides AS (", """half AS (
        SELECT slide_id, x // 2 AS x, y // 2 AS y, floor(avg(r) + 0.5) AS r, floor(avg(g) + 0.5) AS g, floor(avg(b) + 0.5) AS b FROM (
            SELECT s.slide_id, qx.x, qy.y, coalesce(p.r, 255) AS r, coalesce(p.g, 255) AS g, coalesce(p.b, 255) AS b
            FROM (SELECT DISTINCT slide_id FROM b_pixels) s CROSS JOIN (SELECT unnest(range(96)) AS x) qx CROSS JOIN (SELECT unnest(range(72)) AS y) qy
            LEFT JOIN b_pixels p ON p.slide_id = s.slide_id AND p.x = qx.x AND p.y = qy.y) GROUP BY ALL),
        slides AS (""") + """
    SELECT slide_id, 32 AS width, 24 AS height, sum(r)::BIGINT AS sum_r, sum(g)::BIGINT AS sum_g, sum(b)::BIGINT AS sum_b, """ + place_sums("x", "y") + " FROM filled GROUP BY slide_id")
def _(b: Bridge) -> DataFrame:
    pyramid = X.build_pyramid_tiles(b.pixel_tiles, b.pixel_slides, b.pixel_levels)
    return pixel_sums(X.thumbnails(pyramid, b.pixel_slides, b.pixel_levels, max_size=32, block=16))


@query("build_job", oracle("""
    SELECT slide_id, CASE WHEN slide_id % 5 = 3 THEN 'error' ELSE 'done' END AS status,
           CASE WHEN slide_id % 5 = 3 THEN 'input' END AS stage, CASE WHEN slide_id % 5 = 3 THEN 'image bytes do not fit its size' END AS error,
           CASE WHEN slide_id % 5 = 3 THEN 'not_exists' ELSE 'complete' END AS pyramid, CASE WHEN slide_id % 5 = 3 THEN 0 ELSE 44 END AS tiles
    FROM (SELECT DISTINCT slide_id FROM b_pixels)""", "b_pixels"))
def _(b: Bridge) -> DataFrame:
    # One image in five is cut short.
    images = _images(b).select("slide_id", "width", "height", F.expr("IF(slide_id % 5 = 3, substring(rgb, 1, 100), rgb)").alias("rgb"))
    return _built(b, images, _png)


def _sources(b: Bridge) -> DataFrame:
    return b.pixel_slides.select(
        "slide_id", F.concat(F.lit("/in/"), F.col("slide_id"), F.lit(".svs")).alias("path"), F.create_map(F.lit("aperio.MPP"), F.lit("0.25")).alias("props")
    )


def _built(b: Bridge, images: DataFrame, encode) -> DataFrame:
    """Run the build job and look at what it says and at what lies in the folder."""
    root = scratch_path(b.spark, "built")
    slides = _sources(b)
    results = build_job(images, slides, root, tile_size=T, encode=encode)
    named = slides.select(F.col("slide_id").cast("string").alias("slide_id"))
    listing = cut_lineage(pyramid_listing(b.spark, root))
    state = pyramid_status(named, listing, pyramid_documents(listing, root))
    stored = read_tile_index(b.spark, root)[0].filter("length > 0").groupBy("slide_id").agg(F.count(F.lit(1)).cast("int").alias("tiles"))
    return results.withColumn("slide_id", F.col("slide_id").cast("string")).join(state, "slide_id").join(
        stored.withColumn("slide_id", F.col("slide_id").cast("string")), "slide_id", "left"
    ).select(
        F.col("slide_id").cast("bigint").alias("slide_id"), results["status"], "stage", "error", state["status"].alias("pyramid"),
        F.coalesce("tiles", F.lit(0)).alias("tiles"),
    )


def _strips(b: Bridge) -> DataFrame:
    """The same images as strips of 3 tile rows; slides divisible by 4 miss the second strip."""
    step = 3 * T
    part = F.explode(F.sequence(F.lit(0), F.lit(H - 1), F.lit(step))).alias("y_offset")
    cut = _images(b).select("slide_id", "width", part, "rgb").withColumn("height", F.least(F.lit(step), F.lit(H) - F.col("y_offset")))
    row = 3 * W
    bytes_of = F.expr(f"substring(rgb, y_offset * {row} + 1, height * {row})")
    return cut.select("slide_id", "width", "height", "y_offset", bytes_of.alias("rgb")).filter(f"NOT (slide_id % 4 = 0 AND y_offset = {step})")


@query("build_job_strips", oracle("""
    SELECT slide_id, CASE WHEN slide_id % 4 = 0 THEN 'error' ELSE 'done' END AS status,
           CASE WHEN slide_id % 4 = 0 THEN 'input' END AS stage, CASE WHEN slide_id % 4 = 0 THEN 'strips leave a gap or overlap' END AS error,
           CASE WHEN slide_id % 4 = 0 THEN 'not_exists' ELSE 'complete' END AS pyramid, CASE WHEN slide_id % 4 = 0 THEN 0 ELSE 44 END AS tiles
    FROM (SELECT DISTINCT slide_id FROM b_pixels)""", "b_pixels"))
def _(b: Bridge) -> DataFrame:
    return _built(b, _strips(b), _png)


# --- analyses -------------------------------------------------------------


def _mean_gray(rows: pd.DataFrame) -> dict:
    pixels = np.frombuffer(rows.rgb.iloc[0], np.uint8)
    if rows.col.iloc[0] == 5:
        raise ValueError("no result for column 5")
    return {"total": int(pixels.astype(np.int64).sum()), "pixels": len(pixels) // 3}


@query("g01_run_analysis", oracle("""
    SELECT slide_id, CAST(col AS INTEGER) AS col, CAST("row" AS INTEGER) AS "row", col <> 5 AS success,
           CASE WHEN col = 5 THEN 'no result for column 5' ELSE '' END AS message,
           CASE WHEN col <> 5 THEN total END AS total, CASE WHEN col <> 5 THEN pixels END AS pixels
    FROM (SELECT slide_id, col, "row", sum(r + g + b)::BIGINT AS total, count(*) AS pixels FROM b_pixels GROUP BY slide_id, col, "row")""", "b_pixels"))
def _(b: Bridge) -> DataFrame:
    spec = G.AnalysisSpec(
        name="gray total", output_schema="total bigint, pixels bigint", process=_mean_gray, input_kind="tile",
        keys=("slide_id", "col", "row"),
    )
    return G.run_analysis(spec, b.pixel_tiles.select("slide_id", "col", "row", "rgb")).drop("processing_time")


@query("g02_model_analysis", oracle("""
    SELECT slide_id, CAST(col AS INTEGER) AS col, CAST("row" AS INTEGER) AS "row", (2 * sum(r) + 3)::BIGINT AS score FROM b_pixels GROUP BY ALL""", "b_pixels"))
def _(b: Bridge) -> DataFrame:
    model = G.ModelSpec(
        load=lambda: {"weight": 2, "bias": 3},
        predict=lambda m, rows: {
            "score": int(np.frombuffer(rows.rgb.iloc[0], np.uint8)[0::3].astype(np.int64).sum()) * m["weight"] + m["bias"]
        },
    )
    spec = G.AnalysisSpec(
        name="linear", output_schema="score bigint", model=model, input_kind="tile", keys=("slide_id", "col", "row")
    )
    return G.run_analysis(spec, b.pixel_tiles.select("slide_id", "col", "row", "rgb")).select(
        "slide_id", "col", "row", "score"
    )


@query("g01_whole_slide_analysis", oracle("""
    SELECT slide_id, sum(r)::BIGINT AS total, count(DISTINCT (col, "row")) AS tiles FROM b_pixels GROUP BY slide_id""", "b_pixels"))
def _(b: Bridge) -> DataFrame:
    def share(rows) -> tuple[int, int]:
        sums = [int(np.frombuffer(t.rgb, np.uint8)[0::3].astype(np.int64).sum()) for t in rows]
        return sum(sums), len(sums)

    spec = G.AnalysisSpec(
        name="red per slide", output_schema="total bigint, tiles bigint", process=share, input_kind="whole_slide",
        merge=lambda states: {"total": sum(s[0] for s in states), "tiles": sum(s[1] for s in states)}, keys=("slide_id",),
    )
    return G.run_analysis(spec, b.pixel_tiles.select("slide_id", "col", "row", "rgb")).select("slide_id", "total", "tiles")


@query("g03_validate_inputs", """
    SELECT vec_id, label NOT IN (3, 4, 5) AS valid, CASE WHEN label = 3 THEN 'Expected RGB image with 3 channels'
           WHEN label = 5 THEN 'Expected RGB image with 3 channels' WHEN label = 4 THEN 'Expected input size 8x8' ELSE '' END AS message FROM embeddings""")
def _(b: Bridge) -> DataFrame:
    inputs = b.table("embeddings").selectExpr(
        "vec_id", "CASE label WHEN 3 THEN 7 WHEN 4 THEN 4 WHEN 5 THEN 0 ELSE 8 END AS width", "CASE label WHEN 4 THEN 16 ELSE 8 END AS height",
        "unhex(repeat('000000', 64)) AS rgb",
    )
    spec = G.AnalysisSpec(name="any", output_schema="x int", input_size=(8, 8))
    return G.validate_inputs(inputs, spec).select("vec_id", "valid", "message")


def _scores(b: Bridge) -> tuple[DataFrame, DataFrame]:
    levels = with_level_mpp(b.pixel_levels, b.pixel_slides)
    return G.tissue_scores(b.pixel_tiles, levels, mpp=0.6), levels


_SCORES = """SELECT slide_id, CAST(col AS INTEGER) AS col, CAST("row" AS INTEGER) AS "row", greatest(0, 1 - avg((r + g + b) / 3.0) / 255) AS score FROM b_pixels GROUP BY ALL"""


@query("g04_tissue_scores", oracle(f"SELECT slide_id, 4 AS level, col, \"row\", round(score, 6) AS score FROM ({_SCORES})", "b_pixels"))
def _(b: Bridge) -> DataFrame:
    return _scores(b)[0].withColumn("score", F.round("score", 6))


@query("g04_tissue_summary", oracle(f"""
    SELECT slide_id, 4 AS level, count(*) FILTER (WHERE score > 0.5) AS tissue_tiles, CAST(108 AS BIGINT) AS total_tiles,
           round(count(*) FILTER (WHERE score > 0.5) / 108, 6) AS tissue_fraction FROM ({_SCORES}) GROUP BY slide_id""", "b_pixels"))
def _(b: Bridge) -> DataFrame:
    scores, levels = _scores(b)
    return G.tissue_summary(scores, levels, mpp=0.6, threshold=0.5).withColumn(
        "tissue_fraction", F.round("tissue_fraction", 6)
    )


def _regions(b: Bridge) -> DataFrame:
    """Each stored tile as a region, with contrast from the coarser levels' style of names."""
    return b.pixel_tiles.selectExpr("slide_id * 1000 + row * 12 + col AS request_id", "width", "height", "rgb")


_STATS = """
    SELECT slide_id * 1000 + "row" * 12 + col AS request_id, avg(r) / 255 AS mr, avg(g) / 255 AS mg, avg(b) / 255 AS mb,
           stddev_pop(r) / 255 AS sr, stddev_pop(g) / 255 AS sg, stddev_pop(b) / 255 AS sb FROM b_pixels GROUP BY ALL"""


@query("g05_classify_regions", oracle(f"""
    SELECT request_id, label, round(confidence, 6) AS confidence, round(br, 6) AS brightness, round(sat, 6) AS saturation,
           round(CASE WHEN br > 0.8 THEN 1 - sat ELSE 0.1 END, 6) AS p_background, CASE WHEN br < 0.4 THEN 0.1 ELSE 0.05 END::DOUBLE AS p_artifact FROM (
        SELECT *, CASE WHEN br > 0.9 THEN 'Background' WHEN br < 0.3 THEN 'Artifact' WHEN mr > mb AND sat > 0.15 THEN 'Dense Tissue' ELSE 'Tissue' END AS label,
               CASE WHEN br > 0.9 THEN least(0.95, br) WHEN br < 0.3 THEN 0.7 WHEN mr > mb AND sat > 0.15 THEN 0.8 WHEN mr > mb AND sat > 0.1 THEN 0.75 ELSE 0.6 END AS confidence
        FROM (SELECT *, (mr + mg + mb) / 3 AS br, (sr + sg + sb) / 3 AS sat FROM ({_STATS})))""", "b_pixels"))
def _(b: Bridge) -> DataFrame:
    done = G.classify_regions(_regions(b))
    return done.select(
        "request_id", "label", *[F.round(c, 6).alias(c) for c in ("confidence", "brightness", "saturation", "p_background")],
        "p_artifact",
    )


def _channel(name: str, c: str) -> str:
    return (f"round(avg({c}), 6) AS {name}_mean, round(stddev_pop({c}), 6) AS {name}_std, min({c})::INTEGER AS {name}_min, "
            f"max({c})::INTEGER AS {name}_max, median({c})::DOUBLE AS {name}_median")


@query("g06_color_stats", oracle(f"""
    SELECT slide_id * 1000 + "row" * 12 + col AS request_id, {_channel('red', 'r')}, {_channel('green', 'g')}, {_channel('blue', 'b')},
           round(avg((r + g + b) / 3.0), 6) AS gray_mean, round(stddev_pop((r + g + b) / 3.0), 6) AS gray_std,
           count(*) AS pixels, 8 AS width, 8 AS height FROM b_pixels GROUP BY slide_id, "row", col""", "b_pixels"))
def _(b: Bridge) -> DataFrame:
    done = G.color_stats(_regions(b))
    return done.withColumns({c: F.round(c, 6) for c in done.columns if c.endswith(("_mean", "_std"))})


# Outputs of one analysis run per order: which kinds are set depends on the order.
_KINDS = ["o_orderkey AS output_id", "CASE WHEN o_orderkey % 7 = 0 THEN 'x' END AS classification",
          "CASE WHEN o_orderkey % 5 = 0 THEN 'x' END AS tile_scores", "CASE WHEN o_orderkey % 4 = 0 THEN 'x' END AS measurements",
          "CASE WHEN o_orderkey % 3 = 0 THEN 'x' END AS annotations", "CASE WHEN o_orderkey % 11 = 0 THEN 'x' END AS mask",
          "CASE WHEN o_orderkey % 2 = 0 THEN 'x' END AS heatmap", "CASE WHEN o_orderkey % 13 = 0 THEN 'x' END AS image"]


@query("g07_output_type", f"""
    SELECT output_id, CASE WHEN classification IS NOT NULL THEN 'classification' WHEN tile_scores IS NOT NULL THEN 'tile_scores'
        WHEN measurements IS NOT NULL THEN 'measurements' WHEN annotations IS NOT NULL THEN 'annotations' WHEN mask IS NOT NULL THEN 'mask'
        WHEN heatmap IS NOT NULL THEN 'heatmap' WHEN image IS NOT NULL THEN 'image' ELSE 'classification' END AS output_type,
        mask IS NOT NULL AS has_mask, heatmap IS NOT NULL AS has_heatmap, image IS NOT NULL AS has_image, tile_scores IS NOT NULL AS has_tile_scores
    FROM (SELECT {', '.join(_KINDS)} FROM orders)""")
def _(b: Bridge) -> DataFrame:
    return G.with_output_type(b.table("orders").selectExpr(*_KINDS)).select(
        "output_id", "output_type", "has_mask", "has_heatmap", "has_image", "has_tile_scores"
    )


def _outputs(b: Bridge) -> DataFrame:
    """One output per order with one record per line item."""
    lines = b.table("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "named_struct('type', 'point', 'geometry', CASE WHEN l_orderkey % 9 = 4 THEN 'g' END, "
        "'coordinates', CASE WHEN l_orderkey % 8 <> 3 THEN array(named_struct('x', CAST(l_partkey AS DOUBLE), 'y', CAST(l_suppkey AS DOUBLE))) END, "
        "'label', CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE concat('label ', l_linenumber % 4) END, 'color', CAST(NULL AS STRING)) AS a",
    )
    records = lines.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "a"))).alias("r")
    ).select("l_orderkey", F.col("r.a").alias("annotations"))
    return b.table("orders").join(records, F.col("l_orderkey") == F.col("o_orderkey"), "left").selectExpr(
        "o_orderkey AS output_id", "o_custkey AS slide_id", "o_orderstatus <> 'P' AS success", "annotations",
        "named_struct('counts_by_type', CAST(NULL AS MAP<STRING, INT>), "
        "'type_counts', CASE WHEN o_orderkey % 10 = 1 THEN map('a', 2, 'b', 3) END, "
        "'counts', CASE WHEN o_orderkey % 10 <= 2 THEN map('c', 7) END) AS measurements",
    )


@query("g08_route_annotations", oracle("""
    SELECT slide_id, annotation_id, coalesce(label, '') AS label, grp AS "group" FROM b_shapes
    UNION ALL
    SELECT slide_id, concat('ann_', lpad(concat('', last + n), greatest(6, length(concat('', last + n)))::INTEGER, '0')), label, 'detector' FROM (
        SELECT o.o_custkey AS slide_id, CASE WHEN l.l_linenumber % 4 = 0 THEN '' ELSE concat('label ', l.l_linenumber % 4) END AS label,
               coalesce(m.last, 0) AS last,
               row_number() OVER (PARTITION BY o.o_custkey ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey) AS n
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
        LEFT JOIN (SELECT slide_id, max(seq) AS last FROM b_shapes GROUP BY slide_id) m ON m.slide_id = o.o_custkey
        WHERE o.o_orderstatus <> 'P' AND l.l_orderkey % 9 <> 4 AND l.l_orderkey % 8 <> 3)""", "b_shapes"))
def _(b: Bridge) -> DataFrame:
    existing = b.annotations.select("slide_id", "annotation_id", "type", "coordinates", "properties")
    routed = G.route_annotations(_outputs(b), existing, "detector")
    return routed.select(
        "slide_id", "annotation_id", F.coalesce(F.col("properties")["label"], F.lit("")).alias("label"),
        F.col("properties")["group"].alias("group"),
    )


@query("g09_breakdown", """
    SELECT o_orderkey AS output_id, k AS label, n FROM (SELECT o_orderkey, unnest(['a', 'b']) AS k, unnest([2, 3])::BIGINT AS n FROM orders WHERE o_orderkey % 10 = 1)
    UNION ALL SELECT o_orderkey, 'c', 7 FROM orders WHERE o_orderkey % 10 IN (0, 2)
    UNION ALL SELECT l_orderkey, CASE WHEN l_linenumber % 4 = 0 THEN 'Unknown' ELSE concat('label ', l_linenumber % 4) END, count(*) FROM lineitem
              WHERE l_orderkey % 10 > 2 AND l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY ALL""")
def _(b: Bridge) -> DataFrame:
    return G.breakdown(_outputs(b))


@query("g09_totals", """
    WITH sums AS (
        SELECT o_orderkey AS output_id, 5::BIGINT AS total FROM orders WHERE o_orderkey % 10 = 1
        UNION ALL SELECT o_orderkey, 7 FROM orders WHERE o_orderkey % 10 IN (0, 2)
    ), records AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey AS output_id, coalesce(s.total, r.n, 0)::BIGINT AS total
    FROM orders LEFT JOIN sums s ON s.output_id = o_orderkey LEFT JOIN records r ON r.l_orderkey = o_orderkey""")
def _(b: Bridge) -> DataFrame:
    return G.breakdown_totals(_outputs(b))


@query("g10_score_grid", oracle(f"""
    SELECT s.slide_id, 4 AS level, CAST(r AS INTEGER) AS "row", string_agg(coalesce(round(score, 3), 0)::DOUBLE::VARCHAR, ' ' ORDER BY c) AS scores
    FROM (SELECT DISTINCT slide_id FROM b_pixels) s CROSS JOIN (SELECT unnest(range(9)) AS r) CROSS JOIN (SELECT unnest(range(12)) AS c)
    LEFT JOIN ({_SCORES}) p ON p.slide_id = s.slide_id AND p.col = c AND p."row" = r GROUP BY ALL""", "b_pixels"))
def _(b: Bridge) -> DataFrame:
    scores, levels = _scores(b)
    rounded = F.transform("scores", lambda s: F.round(s, 3).cast("string"))
    return G.score_grid(scores, levels, mpp=0.6).withColumn("scores", F.array_join(rounded, " "))


_REGION_SUMS = """
    SELECT q.request_id, CAST(255 * w * h + coalesce(sum(p.r - 255), 0) AS BIGINT) AS total_red FROM (
        SELECT p_partkey AS request_id, p_partkey % 5 AS slide_id, p_size AS x, p_partkey % 30 AS y, 20 + p_partkey % 9 AS w, 12 AS h FROM part) q
    LEFT JOIN b_pixels p ON p.slide_id = q.slide_id AND p.x >= q.x AND p.x < q.x + q.w AND p.y >= q.y AND p.y < q.y + q.h
    WHERE q.slide_id IN (SELECT slide_id FROM b_pixels) GROUP BY q.request_id, w, h"""


def _red(image: bytes) -> int:
    return int(np.frombuffer(image, np.uint8)[0::3].astype(np.int64).sum())


def _analyzed(b: Bridge, spec: G.AnalysisSpec, **options) -> DataFrame:
    rois = b.table("part").selectExpr(
        "p_partkey AS request_id", "p_partkey % 5 AS slide_id", "CAST(p_size AS DOUBLE) AS x", "CAST(p_partkey % 30 AS DOUBLE) AS y",
        "CAST(20 + p_partkey % 9 AS DOUBLE) AS w", "CAST(12 AS DOUBLE) AS h",
    )
    levels = with_level_mpp(b.pixel_levels, b.pixel_slides)
    return analyze_regions(rois, b.pixel_tiles, levels, spec, T, **options).select("request_id", "success", "total_red")


@query("analyze_regions", oracle(_REGION_SUMS.replace("q.request_id, CAST", "q.request_id, true AS success, CAST"), "b_pixels"))
def _(b: Bridge) -> DataFrame:
    return _analyzed(b, G.AnalysisSpec(
        name="red", output_schema="total_red bigint", working_mpp=0.5, process=lambda rows: {"total_red": _red(rows.rgb.iloc[0])},
    ))


@query("analyze_regions_in_blocks", oracle(_REGION_SUMS.replace("q.request_id, CAST", "q.request_id, true AS success, CAST"), "b_pixels"))
def _(b: Bridge) -> DataFrame:
    # Blocks of a few rows each, as a region of many gigapixels has; still one row per request.
    return _analyzed(b, G.AnalysisSpec(
        name="red", output_schema="total_red bigint", working_mpp=0.5, process=lambda rows: sum(_red(r.rgb) for r in rows),
        merge=lambda states: {"total_red": sum(states)},
    ), block_pixels=60)


# --- cells ----------------------------------------------------------------

_ROIS = ["o_orderkey AS roi_id", "o_custkey AS slide_id", "CAST((o_orderkey * 29) % 900 AS DOUBLE) / 4 AS x",
         "CAST((o_orderkey * 71) % 700 AS DOUBLE) / 4 AS y", "CAST(o_totalprice / 100 AS DOUBLE) AS w", "CAST(o_totalprice / 170 AS DOUBLE) AS h"]
_WSI = f"""
    SELECT r.roi_id, r.slide_id, {', '.join(f"CAST(round_even(r.{c} * CASE WHEN s.source_mpp > 0 THEN s.target_mpp / s.source_mpp ELSE 1 END, 0) AS BIGINT) AS {c}" for c in 'xywh')}
    FROM (SELECT {', '.join(_ROIS)} FROM orders) r JOIN b_slides s USING (slide_id)"""


@query("c01_patch_grid", oracle(f"""
    SELECT roi_id, slide_id, CAST(r AS INTEGER) AS patch_row, CAST(c AS INTEGER) AS patch_col, x + c * 960 AS px, y + r * 960 AS py
    FROM (SELECT *, unnest(range(CASE WHEN w <= 1024 THEN 1 ELSE CAST(ceil((w - 1024) / 960) AS BIGINT) + 1 END)) AS c FROM ({_WSI})),
         LATERAL (SELECT unnest(range(CASE WHEN h <= 1024 THEN 1 ELSE CAST(ceil((h - 1024) / 960) AS BIGINT) + 1 END)) AS r)""", "b_slides"))
def _(b: Bridge) -> DataFrame:
    return C.patch_grid(b.table("orders").selectExpr(*_ROIS), b.slides)


@query("c02_eligible", oracle(f"""
    SELECT roi_id, CAST(CASE WHEN source_mpp <= 0 OR round_even(10 / source_mpp, 0) >= 30 THEN 40 ELSE 20 END AS INTEGER) AS magnification
    FROM (SELECT {', '.join(_ROIS)} FROM orders) JOIN b_slides USING (slide_id) WHERE source_mpp <= 0.5""", "b_slides"))
def _(b: Bridge) -> DataFrame:
    return C.eligible(b.table("orders").selectExpr(*_ROIS), b.slides).select("roi_id", "magnification")


def _found(b: Bridge) -> DataFrame:
    """Cells as patches find them: relative to each patch that covers the cell."""
    cells = b.derived("b_cells")
    near = lambda c: f"filter(array(floor({c} / 960), floor({c} / 960) - 1), p -> p >= 0 AND p <= 3 AND {c} < p * 960 + 1024)"
    placed = cells.withColumn("_px", F.explode(F.expr(near("cx")))).withColumn("_py", F.explode(F.expr(near("cy"))))
    return placed.selectExpr(
        "roi_id", "roi_id AS slide_id", "type", "l_orderkey", "l_partkey", "l_linenumber",
        "CAST(_px * 960 AS DOUBLE) AS px", "CAST(_py * 960 AS DOUBLE) AS py", "cx - _px * 960 AS cx", "cy - _py * 960 AS cy",
    ).withColumn("contour", F.expr(
        "slice(array(named_struct('x', cx - 1, 'y', cy - 1), named_struct('x', cx + 1, 'y', cy - 1), named_struct('x', cx, 'y', cy + 2)), 1, "
        "CASE WHEN l_partkey % 10 = 0 THEN 2 ELSE 3 END)"
    ))


_FOUND = """
    SELECT roi_id, roi_id AS slide_id, type, l_orderkey, l_partkey, l_linenumber, cx, cy, p * 960 AS px, q * 960 AS py
    FROM b_cells, (SELECT unnest(range(4)) AS p), (SELECT unnest(range(4)) AS q)
    WHERE p * 960 <= cx AND cx < p * 960 + 1024 AND q * 960 <= cy AND cy < q * 960 + 1024"""


@query("c03_offset_cells", oracle(f"""
    SELECT l_orderkey, l_partkey, l_linenumber, CAST(cx AS DOUBLE) AS cx, CAST(cy AS DOUBLE) AS cy, CAST(px AS DOUBLE) AS px, CAST(py AS DOUBLE) AS py,
           CAST(cx - 1 AS DOUBLE) AS x0 FROM ({_FOUND}) WHERE type <> 0 AND l_partkey % 10 <> 0""", "b_cells"))
def _(b: Bridge) -> DataFrame:
    return C.offset_cells(_found(b)).select(
        "l_orderkey", "l_partkey", "l_linenumber", "cx", "cy", "px", "py", F.get("contour", 0)["x"].alias("x0")
    )


def _kept(b: Bridge) -> DataFrame:
    rois = b.table("supplier").selectExpr("s_suppkey AS roi_id", "0 AS roi_x", "0 AS roi_y", "3904 AS roi_w", "3904 AS roi_h")
    return C.dedupe_cells(C.offset_cells(_found(b)), rois)


_LOW, _HIGH = "CASE WHEN {p} <= 0 THEN {p} ELSE {p} + 32 END", "CASE WHEN {p} + 960 >= 3904 THEN {p} + 1024 ELSE {p} + 992 END"
_OWNED = " AND ".join(
    f"{c} >= {_LOW.format(p=p)} AND {c} < {_HIGH.format(p=p)}" for c, p in (("cx", "px"), ("cy", "py"))
)
_KEPT = f"SELECT * FROM ({_FOUND}) WHERE type <> 0 AND l_partkey % 10 <> 0 AND {_OWNED} AND roi_id IN (SELECT s_suppkey FROM supplier)"


@query("c04_dedupe_cells", oracle(f"""
    SELECT l_orderkey, l_partkey, l_linenumber, CAST(cx AS DOUBLE) AS cx, CAST(cy AS DOUBLE) AS cy, CAST(px AS DOUBLE) AS px, CAST(py AS DOUBLE) AS py FROM ({_KEPT})""", "b_cells"))
def _(b: Bridge) -> DataFrame:
    return _kept(b).select("l_orderkey", "l_partkey", "l_linenumber", "cx", "cy", "px", "py")


_NAMED = """CASE type WHEN 1 THEN 'Neoplastic' WHEN 2 THEN 'Inflammatory' WHEN 3 THEN 'Connective' WHEN 4 THEN 'Dead' WHEN 5 THEN 'Epithelial' ELSE 'Unknown' END"""


@query("c05_cells_to_annotations", oracle(f"""
    SELECT l_orderkey, l_partkey, l_linenumber, {_NAMED} AS label,
           CASE type WHEN 1 THEN '#ff0000' WHEN 2 THEN '#22dd4d' WHEN 3 THEN '#235cec' WHEN 4 THEN '#feff00' WHEN 5 THEN '#ff9f44' ELSE '#808080' END AS color,
           round((cx - 1) / CASE WHEN source_mpp > 0 THEN target_mpp / source_mpp ELSE 1 END, 6) AS x0
    FROM ({_KEPT}) JOIN b_slides USING (slide_id)""", "b_cells", "b_slides"))
def _(b: Bridge) -> DataFrame:
    return C.cells_to_annotations(_kept(b), b.slides).select(
        "l_orderkey", "l_partkey", "l_linenumber", "label", "color", F.round(F.get("coordinates", 0)["x"], 6).alias("x0")
    )


@query("c06_cell_counts", oracle(f"SELECT slide_id, {_NAMED} AS label, count(*) AS n FROM ({_KEPT}) GROUP BY ROLLUP (slide_id, {_NAMED}) HAVING slide_id IS NOT NULL", "b_cells"))
def _(b: Bridge) -> DataFrame:
    return C.cell_counts(_kept(b))


# The mask: gray above 127.  The check finds components by spreading minima.
_MASK = "SELECT slide_id, x, y, v FROM b_pixels WHERE v >= 128"
_LABELS = f"""
    mask AS ({_MASK}),
    spread(slide_id, x, y, label) USING KEY (slide_id, x, y) AS (
        SELECT slide_id, x, y, (y::BIGINT << 32) | x::BIGINT FROM mask
        UNION
        SELECT m.slide_id, m.x, m.y, min(s.label) FROM spread s
        JOIN mask m ON m.slide_id = s.slide_id AND abs(m.x - s.x) + abs(m.y - s.y) = 1 AND m.x BETWEEN s.x - 1 AND s.x + 1
        JOIN recurring.spread o ON o.slide_id = m.slide_id AND o.x = m.x AND o.y = m.y
        WHERE s.label < o.label GROUP BY m.slide_id, m.x, m.y)"""


def _labels_sql(select: str) -> str:
    return oracle("SELECT 0", "b_pixels").rsplit("\nSELECT 0", 1)[0] + f",\n{_LABELS}\n{select}"


def _masks(b: Bridge) -> DataFrame:
    hexed = "array_join(transform(values, v -> CASE WHEN v >= 128 THEN '01' ELSE '00' END), '')"
    return b.pixel_tiles.selectExpr("slide_id", "col", "row", "width", "height", f"unhex({hexed}) AS mask")


@query("c07_label_components", _labels_sql("SELECT slide_id, x, y, label FROM spread"))
def _(b: Bridge) -> DataFrame:
    return label_components(_masks(b), T)


@query("c08_remove_small", _labels_sql("""
    SELECT slide_id, x, y, label FROM (SELECT *, count(*) OVER (PARTITION BY slide_id, label) AS n FROM spread) WHERE n >= 10"""))
def _(b: Bridge) -> DataFrame:
    return R.run_pixels(R.remove_small_runs(R.label_runs(_masks(b), T), T, 10))


@query("c09_instance_table", _labels_sql("""
    SELECT slide_id, label, min(y) AS row_min, max(y) + 1 AS row_max, min(x) AS col_min, max(x) + 1 AS col_max, count(*) AS area,
           round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM spread GROUP BY ALL"""))
def _(b: Bridge) -> DataFrame:
    return R.run_instances(R.label_runs(_masks(b), T), T).withColumns({c: F.round(c, 6) for c in ("cx", "cy")})


def _class_runs(b: Bridge) -> DataFrame:
    hexed = "array_join(transform(values, v -> lpad(hex(v % 4), 2, '0')), '')"
    tiles = b.pixel_tiles.selectExpr("slide_id", "col", "row", "width", "height", f"unhex({hexed}) AS classes")
    return R.tile_runs(tiles, T, "classes", "u1", None)


@query("c10_instance_types", _labels_sql("""
    SELECT slide_id, label, type, round(n / (area + 1e-6), 6) AS type_prob FROM (
        SELECT *, row_number() OVER (PARTITION BY slide_id, label ORDER BY CASE WHEN place = 1 AND type = 0 THEN 3 ELSE place END) AS final FROM (
            SELECT *, row_number() OVER (PARTITION BY slide_id, label ORDER BY n DESC, type) AS place, sum(n) OVER (PARTITION BY slide_id, label) AS area FROM (
                SELECT slide_id, label, v % 4 AS type, count(*) AS n FROM spread JOIN mask USING (slide_id, x, y) GROUP BY ALL))
        WHERE place <= 2) WHERE final = 1"""))
def _(b: Bridge) -> DataFrame:
    # Both images are stored in one layout, so that their tiles meet where they lie.
    labels, classes = [write_tile_store(runs, keys=R.PLACE) for runs in (R.label_runs(_masks(b), T), _class_runs(b))]
    return R.run_types(labels, classes).withColumns({"type": F.col("type").cast("int"), "type_prob": F.round("type_prob", 6)})


@query("c11_threshold_mask", oracle("SELECT slide_id, x, y, CAST(v / 255 >= 0.5 AS INTEGER) AS mask FROM b_pixels", "b_pixels"))
def _(b: Bridge) -> DataFrame:
    return C.threshold_mask(b.pixels.withColumn("prob", F.col("v") / 255)).select("slide_id", "x", "y", "mask")


@query("c11_argmax_class", """
    SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS class FROM embeddings""")
def _(b: Bridge) -> DataFrame:
    return C.argmax_class(b.table("embeddings"), "embedding").select("vec_id", "class")
