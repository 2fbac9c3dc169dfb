"""Choosing pyramid levels.

A slide has a few levels at most (their number grows with the logarithm of its
side), so levels travel as one small array per slide.  A request then needs a
single join on ``slide_id`` and no aggregation afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidelake.functions import slide_to_wsi_scale, to_level
from slidelake.operators.skew import salted_join, shuffled


def nest_levels(levels: DataFrame) -> DataFrame:
    """One row per slide with its levels as an array ordered by level."""
    fields = ["level", "downsample", "cols", "rows"]
    if "mpp" in levels.columns:
        fields.append("mpp")
    return levels.groupBy("slide_id").agg(
        F.max("tile_size").alias("tile_size"),
        F.sort_array(F.collect_list(F.struct(*fields))).alias("levels"),
    )


def with_levels(requests: DataFrame, levels: DataFrame) -> DataFrame:
    """Attach the level array; requests for unknown slides drop out."""
    return salted_join(requests, nest_levels(levels), ["slide_id"])


def _largest(levels: Column, field: str, keep) -> Column:
    """Level struct with the largest ``field`` among those kept, or null."""
    ranked = F.transform(F.filter(levels, keep), lambda l: F.struct(l[field].alias("key"), l.alias("info")))
    return F.array_max(ranked)["info"]


def _smallest(levels: Column, field: str) -> Column:
    ranked = F.transform(levels, lambda l: F.struct(l[field].alias("key"), l.alias("info")))
    return F.array_min(ranked)["info"]


def level_for_scale(requests: DataFrame, levels: DataFrame) -> DataFrame:
    """Add ``level_info``: largest downsample within 1/scale, else the finest level.

    Requests with a scale of zero or less have no level and drop out before
    the division.
    """
    seen = with_levels(requests.filter(F.col("scale") > 0), levels)
    reach = F.lit(1.0) / F.col("scale")
    fitting = _largest(F.col("levels"), "downsample", lambda l: l["downsample"] <= reach)
    return _computed_once(seen, F.coalesce(fitting, _smallest(F.col("levels"), "downsample")))


def level_for_mpp(requests: DataFrame, levels: DataFrame) -> DataFrame:
    """Add ``level_info``: coarsest level whose mpp stays within ``target_mpp``, else the finest."""
    seen = with_levels(requests, levels)
    fitting = _largest(F.col("levels"), "mpp", lambda l: l["mpp"] <= F.col("target_mpp"))
    return _computed_once(seen, F.coalesce(fitting, _smallest(F.col("levels"), "mpp")))


def _computed_once(df: DataFrame, info: Column) -> DataFrame:
    """Add ``level_info`` by exploding a one-element array.

    A plain column would be copied into every filter on the tile range that the
    optimizer pushes below it, and the search would run several times per row.
    """
    return df.select("*", F.explode(F.array(info)).alias("level_info"))


def level_info(requests: DataFrame, levels: DataFrame, on_missing: str = "error") -> DataFrame:
    """Look up ``(slide_id, level)``; unknown levels raise or become (1, 0, 0)."""
    if on_missing not in ("error", "default"):
        raise ValueError("on_missing is 'error' or 'default'")
    known = levels.select("slide_id", "level", "downsample", "cols", "rows")
    joined = salted_join(requests, known.withColumn("_known", F.lit(True)), ["slide_id", "level"], "left")

    def value(name: str, default: int) -> Column:
        if on_missing == "default":
            return F.coalesce(F.col(name), F.lit(default))
        message = F.concat(F.lit("Unknown level: "), F.col("level").cast("string"))
        return F.when(F.col("_known"), F.col(name)).otherwise(F.raise_error(message).cast("int"))

    return (
        joined.withColumn("downsample", value("downsample", 1))
        .withColumn("cols", value("cols", 0))
        .withColumn("rows", value("rows", 0))
        .drop("_known")
    )


def with_level_mpp(levels: DataFrame, slides: DataFrame) -> DataFrame:
    """Add a level's resolution: the pyramid's mpp times the downsample."""
    return levels.join(shuffled(slides.select("slide_id", "target_mpp")), "slide_id").withColumn(
        "mpp", F.col("target_mpp") * F.col("downsample")
    ).drop("target_mpp")


def resolve_regions(rois: DataFrame, levels: DataFrame, working_mpp: float) -> DataFrame:
    """Level, integer level-px rectangle and degraded flag for each slide-px ROI."""
    chosen = level_for_mpp(rois.withColumn("target_mpp", F.lit(float(working_mpp))), levels)
    ds = F.col("level_info.downsample")
    return chosen.select(
        *rois.columns,
        F.col("level_info.level").alias("level"),
        ds.alias("downsample"),
        *[to_level(F.col(c), ds).cast("int").alias(f"level_{c}") for c in ("x", "y", "w", "h")],
        (F.col("level_info.mpp") > F.lit(working_mpp * 1.5)).alias("degraded"),
    )


def needs_original(slides: DataFrame, working_mpp: float, context_mpp: float | None = None) -> DataFrame:
    """Flag slides whose pyramid is coarser than what an analysis asks for."""
    finer = F.lit(float(working_mpp)) < F.col("target_mpp")
    if context_mpp is not None:
        finer = finer | (F.lit(float(context_mpp)) < F.col("target_mpp"))
    return slides.withColumn("needs_original", finer)


def with_wsi_scale(slides: DataFrame) -> DataFrame:
    """Add the slide px to WSI px factor."""
    return slides.withColumn("wsi_scale", slide_to_wsi_scale(F.col("target_mpp"), F.col("source_mpp")))
