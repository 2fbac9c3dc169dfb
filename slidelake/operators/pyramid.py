"""Planning, status and quality rules of tile pyramids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidelake import schema as S
from slidelake.functions import file_stem, level_tile_side
from slidelake.operators.grouping import partitions_of
from slidelake.operators.ordering import explode_range, previous_row
from slidelake.operators.skew import shuffled


def plan_levels(slides: DataFrame) -> DataFrame:
    """Levels of each slide: halve (rounding up) until both sides fit one tile.

    Level 0 is the smallest; the last level has downsample 1.  Repeated halving
    with rounding up equals one division by ``2^k`` with rounding up, so the
    depth comes from integer arithmetic on the row itself: no loop, no shuffle.
    """
    depth = F.expr(
        "size(filter(sequence(0, 31), k -> greatest(width, height) > tile_size * shiftleft(1L, k)))"
    )
    halved = slides.select(
        "slide_id",
        F.col("width").cast("bigint").alias("width"),
        F.col("height").cast("bigint").alias("height"),
        F.col("tile_size").cast("bigint").alias("tile_size"),
    ).withColumn("depth", depth)
    steps = halved.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("depth"))))
    span = F.expr("tile_size * shiftleft(1L, k)")
    return shuffled(steps).select(
        "slide_id",
        (F.col("depth") - F.col("k")).cast("int").alias("level"),
        F.expr("shiftleft(1, k)").cast("int").alias("downsample"),
        F.floor((F.col("width") + span - 1) / span).cast("int").alias("cols"),
        F.floor((F.col("height") + span - 1) / span).cast("int").alias("rows"),
        F.col("tile_size").cast("int").alias("tile_size"),
    )


def grid(levels: DataFrame) -> DataFrame:
    """Every cell of every level's tile grid.

    Grid rows are spread over all tasks before their cells are generated, so
    that one huge level is not expanded by a single task.  The number of
    partitions is stated, since the rows are few bytes but many cells.
    """
    rows = explode_range(levels, F.lit(0), F.col("rows"), "row")
    spread = rows.repartition(partitions_of(rows), "slide_id", "level", "row")
    return explode_range(spread, F.lit(0), F.col("cols"), "col")


def resolve_mpp(slide_props: DataFrame, props: str = "props") -> DataFrame:
    """``source_mpp``: first positive of the known scanner properties, else 0.25."""

    def positive(key: str) -> Column:
        value = F.col(props)[key].try_cast("double")
        return F.when((value > 0) & ~F.isnan(value), value)

    known = [positive(key) for key in S.MPP_PROPERTIES]
    return slide_props.withColumn("source_mpp", F.coalesce(*known, F.lit(S.FALLBACK_MPP)))


def plan_resize(
    slides: DataFrame, target_mpp: float = S.TARGET_MPP, native: bool = False
) -> DataFrame:
    """Resize factor, resulting resolution, magnification and dimensions.

    Finer slides shrink to the target; coarser ones stay as they are and are
    flagged; native mode never resizes.
    """
    mpp = F.col("source_mpp")
    shrinks = F.lit(not native) & (mpp < target_mpp)
    factor = F.when(shrinks, mpp / F.lit(target_mpp)).otherwise(F.lit(1.0))
    actual = F.when(shrinks, F.lit(float(target_mpp))).otherwise(mpp)
    return (
        slides.withColumn("resize_factor", factor)
        .withColumn("actual_mpp", actual)
        .withColumn("coarser_than_target", F.lit(not native) & (mpp > target_mpp))
        .withColumn(
            "magnification",
            F.when(F.col("actual_mpp") > 0, F.lit(S.MAGNIFICATION_AT_1_MPP) / F.col("actual_mpp"))
            .otherwise(F.lit(S.MAGNIFICATION_AT_1_MPP)),
        )
        .withColumn("out_width", F.round(F.col("width") * F.col("resize_factor")).cast("int"))
        .withColumn("out_height", F.round(F.col("height") * F.col("resize_factor")).cast("int"))
    )


def pyramid_name(
    path: Column,
    native: bool = False,
    suffix: str = S.PYRAMID_SUFFIX,
    native_suffix: str = S.NATIVE_SUFFIX,
) -> Column:
    """Folder name of a slide's pyramid: file stem plus the mode's suffix."""
    return F.concat(file_stem(path), F.lit(native_suffix if native else suffix))


def pyramid_status(expected: DataFrame, listing: DataFrame, metadata: DataFrame) -> DataFrame:
    """State of each expected pyramid folder.

    ``listing(slide_id, rel_path)`` has one row per file or folder below the
    pyramid folder (an empty ``rel_path`` for the folder itself);
    ``metadata(slide_id, document)`` has the text of its metadata file.
    """
    found = listing.groupBy("slide_id").agg(
        F.lit(True).alias("has_dir"),
        F.max(F.col("rel_path") == "metadata.json").alias("has_metadata"),
        F.max((F.col("rel_path") == "tiles") | F.col("rel_path").startswith("tiles/")).alias("has_tiles"),
        F.max(F.col("rel_path") == "thumbnail.jpg").alias("has_thumbnail"),
    )
    keys = F.json_object_keys("document")
    parsed = metadata.select(
        "slide_id",
        F.from_json("document", "levels ARRAY<STRUCT<level: INT>>, tile_format STRING").alias("doc"),
        F.coalesce(
            F.size(F.array_intersect(keys, F.array(*map(F.lit, S.METADATA_REQUIRED))))
            == len(S.METADATA_REQUIRED),
            F.lit(False),
        ).alias("has_keys"),
    ).select(
        "slide_id",
        (
            F.col("has_keys")
            & F.coalesce(F.col("doc.tile_format") == S.TILE_FORMAT, F.lit(False))
            & F.col("doc.levels").isNotNull()
        ).alias("readable"),
        "doc.levels",
    )
    entries = parsed.filter("readable").select("slide_id", F.posexplode("levels").alias("pos", "entry"))
    files = entries.select(
        "slide_id",
        "pos",
        F.col("entry.level").alias("level"),
        F.explode(F.array(F.lit("pack"), F.lit("idx"))).alias("kind"),
    ).withColumn("rel_path", F.format_string("tiles/level_%d.%s", F.col("level"), F.col("kind")))
    present = listing.select("slide_id", "rel_path").distinct().withColumn("present", F.lit(True))
    problems = (
        files.join(shuffled(present), ["slide_id", "rel_path"], "left")
        .filter(F.col("level").isNull() | F.col("present").isNull())
        .groupBy("slide_id")
        .agg(
            F.min_by(
                F.when(F.col("level").isNull(), F.lit("corrupted")).otherwise(F.lit("incomplete")), "pos"
            ).alias("level_problem")
        )
    )
    return (
        expected.join(shuffled(found), "slide_id", "left")
        .join(shuffled(parsed.select("slide_id", "readable")), "slide_id", "left")
        .join(shuffled(problems), "slide_id", "left")
        .withColumn(
            "status",
            F.when(F.col("has_dir").isNull(), "not_exists")
            .when(~F.col("has_metadata"), "incomplete")
            .when(~F.coalesce(F.col("readable"), F.lit(False)), "corrupted")
            .when(~F.col("has_tiles"), "incomplete")
            .when(F.col("level_problem").isNotNull(), F.col("level_problem"))
            .when(~F.col("has_thumbnail"), "incomplete")
            .otherwise("complete"),
        )
        .drop("has_dir", "has_metadata", "has_tiles", "has_thumbnail", "readable", "level_problem")
    )


def plan_batch(
    discovered: DataFrame, status: DataFrame, force: bool = False, native: bool = False
) -> DataFrame:
    """Skip complete pyramids unless forced, build all others.

    ``status(slide_id, status, native_mpp_mode)``; a skipped pyramid made in the
    other resolution mode is flagged.
    """
    state = status.select("slide_id", "status", "native_mpp_mode")
    skip = (F.col("status") == "complete") & F.lit(not force)
    return (
        discovered.join(shuffled(state), "slide_id", "left")
        .withColumn("status", F.coalesce("status", F.lit("not_exists")))
        .withColumn("action", F.when(skip, "skip").otherwise("build"))
        .withColumn(
            "mode_mismatch",
            skip & (F.coalesce(F.col("native_mpp_mode"), F.lit(False)) != F.lit(native)),
        )
        .drop("native_mpp_mode")
    )


def to_build(plan: DataFrame, done: DataFrame) -> DataFrame:
    """Planned builds that have no finished pyramid yet."""
    return plan.filter(F.col("action") == "build").join(shuffled(done.select("slide_id")), "slide_id", "left_anti")


def summarize_batch(results: DataFrame) -> DataFrame:
    """Processed, skipped and failed counts of a batch of ``(file, status, error)``."""
    return results.agg(
        F.count_if(F.col("status") == "done").alias("processed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.count_if(F.col("status") == "error").alias("failed"),
    )


def batch_failures(results: DataFrame) -> DataFrame:
    """Failed files with their message; stays a table since it grows with the batch."""
    return results.filter(F.col("status") == "error").select(
        file_name_of("file").alias("file"),
        F.coalesce("error", F.lit("Unknown error")).alias("error"),
    )


def file_name_of(column: str) -> Column:
    return F.element_at(F.split(F.col(column), "/"), -1)


def validate_slides(slides: DataFrame, levels: DataFrame) -> DataFrame:
    """Violated metadata rules, one row per slide, rule and level."""
    def broken(rules: dict[str, Column]) -> Column:
        """The names of the violated rules, one row each."""
        named = F.array(*[F.when(condition, F.lit(name)) for name, condition in rules.items()])
        return F.explode(F.filter(named, lambda name: name.isNotNull())).alias("rule")

    no_level = F.lit(None).cast("int").alias("level")
    of_slides = slides.select("slide_id", broken({
        "dimensions": (F.col("width") <= 0) | (F.col("height") <= 0), "tile_size": F.col("tile_size") <= 0,
    }), no_level)
    of_levels = levels.select("slide_id", broken({
        "downsample": F.col("downsample") <= 0, "cols": F.col("cols") <= 0, "rows": F.col("rows") <= 0,
    }), "level")
    without = (
        slides.join(shuffled(levels.select("slide_id").distinct()), "slide_id", "left_anti")
        .select("slide_id", F.lit("levels_empty").alias("rule"), no_level)
    )
    twice = (
        levels.groupBy("slide_id", "level").count().filter("count > 1")
        .select("slide_id", F.lit("duplicate_level").alias("rule"), "level")
    )
    return of_slides.unionByName(of_levels).unionByName(without).unionByName(twice)


def missing_tiles(levels: DataFrame, tile_index: DataFrame) -> DataFrame:
    """Grid cells without a stored tile."""
    stored = tile_index.filter(F.col("length") > 0).select("slide_id", "level", "col", "row")
    return grid(levels).select("slide_id", "level", "col", "row").join(
        shuffled(stored), ["slide_id", "level", "col", "row"], "left_anti"
    )


def validate_index(index: DataFrame, pack_files: DataFrame) -> DataFrame:
    """Index entries that leave their pack or do not continue the previous tile.

    Rows of one grid row share a task (at most 65535 entries by format), so a
    huge level is checked by many tasks.
    """
    stored = index.filter(F.col("length") > 0)
    linked = previous_row(
        stored, ["slide_id", "level"], F.col("row"), ["row", "col"], ["offset", "length"],
        beside=pack_files.select("slide_id", "level", "pack_length"),
    )
    expected = F.coalesce(F.col("prev.offset") + F.col("prev.length"), F.lit(0))
    checked = linked.select(
        "slide_id", "level", "col", "row", "offset", "length",
        (F.col("offset") + F.col("length") > F.coalesce("pack_length", F.lit(0))).alias("out_of_pack"),
        (F.col("offset") != expected).alias("not_contiguous"),
    )
    return checked.filter("out_of_pack OR not_contiguous")


def tile_side(levels: DataFrame) -> DataFrame:
    """Add the side of a level's tiles in slide px."""
    return levels.withColumn("tile_side", level_tile_side(F.col("tile_size"), F.col("downsample")))
