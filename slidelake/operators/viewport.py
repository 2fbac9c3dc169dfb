"""Viewports to tiles: visibility, prefetch ranking and budgets, request logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidelake import schema as S
from slidelake.operators.levels import level_for_scale
from slidelake.operators.ordering import explode_range, previous_row
from slidelake.operators.pyramid import grid
from slidelake.operators.skew import salted_join, shuffled

TILE = ["slide_id", "level", "col", "row"]


@dataclass(frozen=True)
class PrefetchConfig:
    """Shape of the prefetch area around a viewport."""

    tiles_ahead: int = 2
    tiles_around: int = 1
    prefetch_levels: bool = True
    min_velocity: float = 50.0


def _tiles_in_rect(
    df: DataFrame, info: Column, x: Column, y: Column, w: Column, h: Column, edge: str
) -> DataFrame:
    """Explode the tile range under a slide-px rectangle, clamped to the level's grid."""
    side = (F.col("tile_size").cast("bigint") * info["downsample"]).cast("double")
    if edge == "trunc":
        start = lambda v: (v / side).cast("bigint")
        end = lambda v: (v / side).cast("bigint") + 1
    elif edge == "ceil":
        start = lambda v: F.floor(v / side)
        end = lambda v: F.ceil(v / side)
    else:
        raise ValueError("edge is 'trunc' or 'ceil'")
    ranged = df.select(
        "*",
        info["level"].alias("level"),
        F.greatest(F.lit(0).cast("bigint"), start(x)).alias("_c0"),
        F.least(info["cols"].cast("bigint"), end(x + w)).alias("_c1"),
        F.greatest(F.lit(0).cast("bigint"), start(y)).alias("_r0"),
        F.least(info["rows"].cast("bigint"), end(y + h)).alias("_r1"),
    ).filter((F.col("_c1") > F.col("_c0")) & (F.col("_r1") > F.col("_r0")))
    rows = explode_range(ranged, F.col("_r0"), F.col("_r1"), "row")
    return explode_range(rows, F.col("_c0"), F.col("_c1"), "col").drop("_c0", "_c1", "_r0", "_r1")


def visible_tiles(viewports: DataFrame, levels: DataFrame, edge: str = "trunc") -> DataFrame:
    """Tiles under each viewport at the level its scale asks for.

    ``edge='trunc'`` is the viewer's rule (a right edge on a tile border adds a
    column), ``edge='ceil'`` the scheduler's.
    """
    leveled = level_for_scale(viewports, levels)
    tiles = _tiles_in_rect(
        leveled, F.col("level_info"), F.col("x"), F.col("y"), F.col("width"), F.col("height"), edge
    )
    return tiles.drop("levels", "level_info", "tile_size")


def tile_position(tiles: DataFrame, slides: DataFrame, levels: DataFrame) -> DataFrame:
    """Tile rectangle in slide px, cut at the slide's border and never negative."""
    sized = levels.select("slide_id", "level", "downsample", "tile_size").join(
        shuffled(slides.select("slide_id", F.col("width").alias("_w"), F.col("height").alias("_h"))), "slide_id"
    )
    placed = salted_join(tiles, sized, ["slide_id", "level"])
    side = F.col("tile_size").cast("bigint") * F.col("downsample")
    zero = F.lit(0).cast("bigint")
    return (
        placed.withColumn("x", F.col("col") * side)
        .withColumn("y", F.col("row") * side)
        .withColumn("width", F.greatest(zero, F.least(side, F.col("_w") - F.col("x"))))
        .withColumn("height", F.greatest(zero, F.least(side, F.col("_h") - F.col("y"))))
        .drop("downsample", "tile_size", "_w", "_h")
    )


def tile_bounds(tiles: DataFrame, levels: DataFrame) -> DataFrame:
    """Tile rectangle in slide px, not cut at the slide's border."""
    side = (F.col("tile_size").cast("bigint") * F.col("downsample")).cast("double")
    placed = salted_join(
        tiles, levels.select("slide_id", "level", "downsample", "tile_size"), ["slide_id", "level"]
    )
    return (
        placed.withColumn("x", F.col("col") * side)
        .withColumn("y", F.col("row") * side)
        .withColumn("width", side)
        .withColumn("height", side)
        .drop("downsample", "tile_size")
    )


def extend_viewport(viewports: DataFrame, config: PrefetchConfig = PrefetchConfig()) -> DataFrame:
    """Add ``ext_x, ext_y, ext_width, ext_height``: a tile ring plus a reach along fast motion.

    The extension is counted in tiles of slide px, whatever the level.
    """
    tile = F.col("tile_size").cast("double")
    ring = tile * config.tiles_around

    def reach(velocity: str) -> Column:
        moving = F.abs(F.col(velocity)) > config.min_velocity
        return F.when(moving, F.signum(F.col(velocity)) * tile * config.tiles_ahead).otherwise(F.lit(0.0))

    zero = F.lit(0.0)
    return (
        viewports.withColumn("_rx", reach("velocity_x"))
        .withColumn("_ry", reach("velocity_y"))
        .withColumn("ext_x", F.col("x") - ring + F.least(F.col("_rx"), zero))
        .withColumn("ext_y", F.col("y") - ring + F.least(F.col("_ry"), zero))
        .withColumn("ext_width", F.col("width") + ring * 2 + F.abs(F.col("_rx")))
        .withColumn("ext_height", F.col("height") + ring * 2 + F.abs(F.col("_ry")))
        .drop("_rx", "_ry")
    )


def rank_prefetch(
    viewports: DataFrame,
    levels: DataFrame,
    cached: DataFrame | None = None,
    config: PrefetchConfig = PrefetchConfig(),
) -> DataFrame:
    """Tiles worth loading per viewport with their priority class.

    Classes: 0 visible, 1 extended area, 2 next finer index over the viewport,
    3 next lower index over the centred quarter-size box.  A tile keeps its
    first class.  All four areas come from one pass over the viewports: each
    becomes a struct in an array that is exploded, so nothing is scanned twice.
    """
    base = extend_viewport(level_for_scale(viewports, levels), config)
    base = base.select(
        "viewport_id", "slide_id", "tile_size", "levels", "level_info",
        *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")],
        "ext_x", "ext_y", "ext_width", "ext_height",
    )

    def neighbour(step: int) -> Column:
        wanted = F.col("level_info.level") + step
        found = F.filter(F.col("levels"), lambda l: l["level"] == wanted)
        inside = (wanted >= 0) & (wanted < F.size("levels"))
        return F.when(inside, F.get(found, 0))

    def area(priority: int, info: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
        return F.struct(
            F.lit(priority).alias("priority"), info.alias("info"),
            x.alias("ax"), y.alias("ay"), w.alias("aw"), h.alias("ah"),
        )

    x, y, w, h = (F.col(c) for c in ("x", "y", "width", "height"))
    areas = [
        area(0, F.col("level_info"), x, y, w, h),
        area(1, F.col("level_info"), *(F.col(c) for c in ("ext_x", "ext_y", "ext_width", "ext_height"))),
    ]
    if config.prefetch_levels:
        areas.append(area(2, neighbour(1), x, y, w, h))
        areas.append(
            area(3, neighbour(-1), x + w / 2 - w / 8, y + h / 2 - h / 8, w / 4, h / 4)
        )
    wanted = base.select(
        "viewport_id", "slide_id", "tile_size", F.explode(F.array(*areas)).alias("a")
    ).filter(F.col("a.info").isNotNull())
    tiles = _tiles_in_rect(
        wanted, F.col("a.info"), F.col("a.ax"), F.col("a.ay"), F.col("a.aw"), F.col("a.ah"), "ceil"
    )
    ranked = tiles.groupBy("viewport_id", *TILE).agg(F.min("a.priority").alias("priority"))
    if cached is not None:
        ranked = ranked.join(shuffled(cached.select(*TILE)), TILE, "left_anti")
    return ranked


def budget_prefetch(
    ranked: DataFrame,
    max_visible: int = S.MAX_VISIBLE_TILES,
    extended_budget: int = S.EXTENDED_TILE_BUDGET,
) -> DataFrame:
    """Cut each viewport's list to its loading budget, in rank order.

    All visible tiles up to ``max_visible``; other tiles only fill up to
    ``extended_budget``.  The first filter bounds the rank by a constant, so
    Spark keeps only the best rows of a viewport before the shuffle.
    """
    by_rank = Window.partitionBy("viewport_id").orderBy("priority", "row", "col")
    most = max(max_visible, extended_budget)
    short = ranked.withColumn("rank", F.row_number().over(by_rank)).filter(F.col("rank") <= most)
    visible = F.count_if(F.col("priority") == 0).over(Window.partitionBy("viewport_id"))
    return (
        short.withColumn("_visible", visible)
        .filter(
            F.col("rank") <= F.greatest(F.least(F.col("_visible"), F.lit(max_visible)), F.lit(extended_budget))
        )
        .drop("_visible")
    )


def warmup_tiles(levels: DataFrame, max_tiles: int = S.WARMUP_MAX_TILES) -> DataFrame:
    """All tiles of the levels that have few tiles."""
    small = levels.filter(F.col("cols").cast("bigint") * F.col("rows") <= max_tiles)
    return grid(small).select(*TILE)


def preload_worklist(levels: DataFrame, cached: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """Every tile of every readable slide that is not cached yet."""
    wanted = levels if unreadable is None else levels.join(shuffled(unreadable), "slide_id", "left_anti")
    return grid(wanted).select(*TILE).join(shuffled(cached.select(*TILE)), TILE, "left_anti")


def preload_counts(
    levels: DataFrame, cached: DataFrame, tile_index: DataFrame, unreadable: DataFrame | None = None
) -> DataFrame:
    """Per slide: tiles loaded, failed (not stored) and skipped (already cached).

    The total comes from the level sizes, and only cached and stored tiles are
    joined, so the full grid is never built.
    """
    wanted = levels if unreadable is None else levels.join(shuffled(unreadable), "slide_id", "left_anti")
    in_grid = wanted.select("slide_id", "level", "cols", "rows")

    def known(df: DataFrame, flag: str) -> DataFrame:
        return df.select(*TILE).distinct().withColumn(flag, F.lit(True))

    stored = known(tile_index.filter(F.col("length") > 0), "stored")
    tiles = known(cached, "cached").join(shuffled(stored), TILE, "full")
    tiles = tiles.join(shuffled(in_grid), ["slide_id", "level"]).filter(
        (F.col("col") >= 0) & (F.col("row") >= 0)
        & (F.col("col") < F.col("cols")) & (F.col("row") < F.col("rows"))
    )
    hits = tiles.groupBy("slide_id").agg(
        F.count_if("cached").alias("_skipped"),
        F.count_if(F.col("stored") & F.col("cached").isNull()).alias("_loaded"),
    )
    totals = in_grid.groupBy("slide_id").agg(
        F.sum(F.col("cols").cast("bigint") * F.col("rows")).alias("_total")
    )
    zero = F.lit(0).cast("bigint")
    return totals.join(shuffled(hits), "slide_id", "left").select(
        "slide_id",
        F.coalesce("_loaded", zero).alias("loaded"),
        (F.col("_total") - F.coalesce("_loaded", zero) - F.coalesce("_skipped", zero)).alias("failed"),
        F.coalesce("_skipped", zero).alias("skipped"),
    )


def filter_cached(
    requested: DataFrame, cached: DataFrame, threshold: float = S.CACHE_MISS_THRESHOLD
) -> DataFrame:
    """Only cached tiles of a viewport, or all of them when too few are cached.

    The share is a grouped count joined back, so that it combines before the
    shuffle instead of sorting each viewport in a window.
    """
    flagged = requested.join(
        shuffled(cached.select(*TILE).distinct().withColumn("_cached", F.lit(True))), TILE, "left"
    )
    share = flagged.groupBy("viewport_id").agg(
        F.count_if("_cached").alias("_hits"), F.count(F.lit(1)).alias("_all")
    )
    too_few = F.col("_hits") < F.col("_all") * F.lit(threshold)
    return (
        flagged.join(shuffled(share), "viewport_id")
        .filter(too_few | F.coalesce(F.col("_cached"), F.lit(False)))
        .drop("_cached", "_hits", "_all")
    )


def cache_stats(access_log: DataFrame) -> DataFrame:
    """Hits, misses, hit ratio, bytes and distinct tiles per cache tier."""
    stats = access_log.groupBy("tier").agg(
        F.count_if("hit").alias("hits"),
        F.count_if(~F.col("hit")).alias("misses"),
    )
    held = (
        access_log.groupBy("tier", *TILE).agg(F.max("bytes").alias("bytes"))
        .groupBy("tier").agg(F.count(F.lit(1)).alias("tiles"), F.sum("bytes").alias("bytes"))
    )
    total = F.col("hits") + F.col("misses")
    return stats.join(held, "tier").withColumn(
        "hit_ratio", F.when(total > 0, F.col("hits") / total).otherwise(F.lit(0.0))
    )


def tileset_changes(
    viewport_tiles: DataFrame, bucket: Column | None = None
) -> DataFrame:
    """Updates whose tile set differs from the viewer's previous update.

    Repeated tiles are dropped first; then a set is compared by its size and two
    independent 64-bit fingerprints, so tiles are never collected.  The row names the
    previous update as fallback when the level changed.  ``bucket`` splits a
    viewer's timeline (default: one hour), so a busy viewer spans many tasks.
    """
    tile = F.struct("level", "col", "row")
    distinct = viewport_tiles.select("viewer_id", "ts", "seq", "level", "col", "row").distinct()
    sets = distinct.groupBy("viewer_id", "ts", "seq").agg(
        F.max("level").alias("level"),
        F.count(F.lit(1)).alias("n_tiles"),
        F.bit_xor(F.xxhash64(F.lit(1), tile)).alias("_f1"),
        F.sum(F.xxhash64(F.lit(2), tile).cast("decimal(20,0)")).alias("_f2"),
    )
    linked = previous_row(
        sets, ["viewer_id"], bucket if bucket is not None else F.date_trunc("hour", "ts"),
        ["ts", "seq"], ["seq", "level", "n_tiles", "_f1", "_f2"],
    )
    same = (
        F.col("prev.n_tiles").eqNullSafe(F.col("n_tiles"))
        & F.col("prev._f1").eqNullSafe(F.col("_f1"))
        & F.col("prev._f2").eqNullSafe(F.col("_f2"))
    )
    return linked.filter(~same).select(
        "viewer_id", "ts", "seq", "level", "n_tiles",
        F.when(F.col("prev.level") != F.col("level"), F.col("prev.seq")).alias("fallback_seq"),
    )


def pan_velocity(positions: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Velocity in slide px per second from successive content positions.

    Positions are on-screen px; the first position of a viewer and positions
    with no elapsed time have velocity 0.
    """
    linked = previous_row(
        positions, ["viewer_id"], bucket if bucket is not None else F.date_trunc("hour", "ts"),
        ["ts", "seq"], ["ts", "content_x", "content_y"],
    )
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("prev.ts").cast("timestamp"))
    seconds = micros / F.lit(1e6)

    def velocity(axis: str) -> Column:
        moved = F.col(axis) - F.col(f"prev.{axis}")
        return F.coalesce(F.try_divide(F.try_divide(moved, seconds), F.col("scale")), F.lit(0.0))

    return (
        linked.withColumn("velocity_x", velocity("content_x"))
        .withColumn("velocity_y", velocity("content_y"))
        .drop("prev")
    )


def dedupe_requests(requests: DataFrame) -> DataFrame:
    """First request per slide and tile within the viewer's newest generation."""
    newest = requests.groupBy("viewer_id").agg(F.max("generation").alias("_newest"))
    current = salted_join(requests, newest, ["viewer_id"]).filter(F.col("generation") == F.col("_newest"))
    others = [c for c in requests.columns if c not in TILE]
    return current.groupBy(*TILE).agg(
        F.min_by(F.struct(*others), "seq").alias("_first")
    ).select(*TILE, "_first.*")


def preload_order(siblings: DataFrame) -> DataFrame:
    """Rank slides of a folder for preloading: current, +1, -1, +2, -2 and so on.

    Uses ``idx``, ``current_idx`` and ``n`` from the sibling listing.  The rank
    has a closed form, so no window over the folder is needed.
    """
    delta = F.col("idx") - F.col("current_idx")
    ahead = F.col("n") - 1 - F.col("current_idx")
    rank = (
        F.when(delta == 0, F.lit(0))
        .when(delta > 0, delta + F.least(delta - 1, F.col("current_idx")))
        .otherwise(-delta + F.least(-delta, ahead))
    )
    return siblings.filter(F.col("n") > 1).withColumn("preload_rank", rank.cast("bigint"))
