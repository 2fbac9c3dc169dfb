"""Cell detection around the network: patches, ownership, instances and types.

Pixel tables have ``slide_id, x, y`` in one image space plus their value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidelake import schema as S
from slidelake.functions import slide_to_wsi_scale
from slidelake.operators.ordering import explode_range
from slidelake.operators.skew import salted_join

STRIDE = S.PATCH_SIZE - S.PATCH_OVERLAP
# Fixed thresholds for eligible scans.
MAX_SOURCE_MPP = 0.5
HIGH_MAGNIFICATION = 40
LOW_MAGNIFICATION = 20


def patch_count(length: Column) -> Column:
    """Overlapping patches needed along one side."""
    return F.when(length <= S.PATCH_SIZE, F.lit(1).cast("bigint")).otherwise(
        F.ceil((length - S.PATCH_SIZE) / F.lit(STRIDE)) + 1
    )


def wsi_rois(rois: DataFrame, slides: DataFrame) -> DataFrame:
    """ROI rectangles in integer WSI px, rounded half to even."""
    scaled = salted_join(rois, slides.select("slide_id", "source_mpp", "target_mpp"), ["slide_id"]).withColumn(
        "wsi_scale", slide_to_wsi_scale(F.col("target_mpp"), F.col("source_mpp"))
    )
    return scaled.withColumns(
        {f"wsi_{c}": F.bround(F.col(c) * F.col("wsi_scale")).cast("bigint") for c in ("x", "y", "w", "h")}
    )


def patch_grid(rois: DataFrame, slides: DataFrame) -> DataFrame:
    """Origins of the overlapping patches of each ROI, in WSI px."""
    sized = wsi_rois(rois, slides)
    rows = explode_range(sized, F.lit(0), patch_count(F.col("wsi_h")), "patch_row")
    cells = explode_range(rows, F.lit(0), patch_count(F.col("wsi_w")), "patch_col")
    return cells.select(
        "roi_id", "slide_id", "patch_row", "patch_col",
        (F.col("wsi_x") + F.col("patch_col") * STRIDE).alias("px"),
        (F.col("wsi_y") + F.col("patch_row") * STRIDE).alias("py"),
    )


def eligible(rois: DataFrame, slides: DataFrame) -> DataFrame:
    """ROIs on scans fine enough for detection, with the magnification to use."""
    mpp = F.col("source_mpp")
    high = (mpp <= 0) | (F.bround(F.lit(S.MAGNIFICATION_AT_1_MPP) / mpp) >= 30)
    present = rois.filter(F.col("roi_id").isNotNull())
    return (
        salted_join(present, slides.select("slide_id", "source_mpp"), ["slide_id"])
        .filter(mpp <= MAX_SOURCE_MPP)
        .withColumn("magnification", F.when(high, HIGH_MAGNIFICATION).otherwise(LOW_MAGNIFICATION))
    )


def offset_cells(patch_cells: DataFrame) -> DataFrame:
    """Patch-relative cells to image px; drop untyped cells and degenerate contours."""
    kept = patch_cells.filter((F.coalesce(F.col("type"), F.lit(0)) != 0) & (F.size("contour") >= 3))
    return kept.withColumn(
        "contour",
        F.transform(
            "contour",
            lambda p: F.struct((p["x"] + F.col("px")).alias("x"), (p["y"] + F.col("py")).alias("y")),
        ),
    ).withColumn("cx", F.col("cx") + F.col("px")).withColumn("cy", F.col("cy") + F.col("py"))


def dedupe_cells(cells: DataFrame, rois: DataFrame) -> DataFrame:
    """Keep a cell only in the patch that owns its centroid.

    A patch owns its core, which reaches the patch edge on the ROI's border.
    Ownership is decided row by row, so copies never have to meet.
    ``rois(roi_id, roi_x, roi_y, roi_w, roi_h)`` is in the cells' px.
    """
    margin = S.PATCH_OVERLAP // 2
    joined = salted_join(cells, rois.select("roi_id", "roi_x", "roi_y", "roi_w", "roi_h"), ["roi_id"])

    def owned(center: str, origin: str, roi: str, length: str) -> Column:
        o = F.col(origin)
        low = F.when(o <= F.col(roi), o).otherwise(o + margin)
        at_end = o + STRIDE >= F.col(roi) + F.col(length)
        high = F.when(at_end, o + S.PATCH_SIZE).otherwise(o + S.PATCH_SIZE - margin)
        return (F.col(center) >= low) & (F.col(center) < high)

    return joined.filter(owned("cx", "px", "roi_x", "roi_w") & owned("cy", "py", "roi_y", "roi_h")).drop(
        "roi_x", "roi_y", "roi_w", "roi_h"
    )


def type_name(kind: Column) -> Column:
    """Label and colour of a cell type, with a fallback for unknown types."""
    label, color = F.lit(S.UNKNOWN_LABEL), F.lit(S.UNKNOWN_COLOR)
    for number, (name, value) in S.CELL_TYPES.items():
        label = F.when(kind == number, F.lit(name)).otherwise(label)
        color = F.when(kind == number, F.lit(value)).otherwise(color)
    return F.struct(label.alias("label"), color.alias("color"))


def cells_to_annotations(cells: DataFrame, slides: DataFrame) -> DataFrame:
    """Cell contours in WSI px to polygon annotations in slide px."""
    scaled = salted_join(
        cells.filter(F.size("contour") >= 3),
        slides.select("slide_id", "source_mpp", "target_mpp"), ["slide_id"],
    ).withColumn("_scale", slide_to_wsi_scale(F.col("target_mpp"), F.col("source_mpp")))
    return scaled.withColumn("_type", type_name(F.col("type"))).withColumns(
        {
            "coordinates": F.transform(
                "contour",
                lambda p: F.struct((p["x"] / F.col("_scale")).alias("x"), (p["y"] / F.col("_scale")).alias("y")),
            ),
            "label": F.col("_type.label"),
            "color": F.col("_type.color"),
            "type": F.lit("polygon"),
        }
    ).drop("_type", "_scale", "contour", "source_mpp", "target_mpp")


def cell_counts(cells: DataFrame) -> DataFrame:
    """Cells per slide and label, with the slide's total in a row without label."""
    labelled = cells.withColumn("label", type_name(F.col("type"))["label"])
    return (
        labelled.rollup("slide_id", "label")
        .agg(F.count(F.lit(1)).alias("n"), F.grouping("slide_id").alias("_all"))
        .filter(F.col("_all") == 0)
        .drop("_all")
    )


def remove_small(label_pixels: DataFrame, min_size: int = 10) -> DataFrame:
    """Drop components of fewer than ``min_size`` pixels.

    Sizes are grouped counts joined back: they combine before the shuffle, and
    the join's salt comes from the pixels, so a component of any size spreads.
    """
    if min_size == 0:
        return label_pixels
    sizes = label_pixels.groupBy("slide_id", "label").agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") >= min_size)
    return salted_join(label_pixels, large.drop("_n"), ["slide_id", "label"])


def instance_table(label_pixels: DataFrame) -> DataFrame:
    """Bounding box (high ends exclusive), area and centroid of each instance."""
    return label_pixels.groupBy("slide_id", "label").agg(
        F.min("y").alias("row_min"), (F.max("y") + 1).alias("row_max"),
        F.min("x").alias("col_min"), (F.max("x") + 1).alias("col_max"),
        F.count(F.lit(1)).alias("area"),
        F.avg("x").alias("cx"), F.avg("y").alias("cy"),
    )


def instance_types(label_pixels: DataFrame, type_pixels: DataFrame) -> DataFrame:
    """Most frequent pixel class of each instance and its share, from pixel tables.

    Per instance only the class counts meet.  Label images in tiles are better
    served by :mod:`slidelake.operators.labelruns`, which moves no pixels.
    """
    return pick_types(
        label_pixels.join(type_pixels, ["slide_id", "x", "y"])
        .groupBy("slide_id", "label", "type").agg(F.count(F.lit(1)).alias("n"))
    )


def pick_types(classes: DataFrame) -> DataFrame:
    """Class and share of each instance from its counts ``(slide_id, label, type, n)``.

    Class 0 yields to the second most frequent class when there is one; ties go
    to the smaller class.
    """
    best = F.struct((-F.col("n")).alias("minus_n"), F.col("type").alias("type"))
    tops = classes.groupBy("slide_id", "label").agg(
        F.sum("n").alias("area"),
        F.min(best).alias("first"),
        F.min(F.when(F.col("type") != 0, best)).alias("first_typed"),
    )
    pick = F.when(
        (F.col("first.type") == 0) & F.col("first_typed").isNotNull(), F.col("first_typed")
    ).otherwise(F.col("first"))
    return tops.select("slide_id", "label", "area", pick.alias("p")).select(
        "slide_id", "label",
        F.col("p.type").alias("type"),
        (-F.col("p.minus_n") / (F.col("area") + F.lit(1.0e-6))).alias("type_prob"),
    )


def threshold_mask(df: DataFrame, probability: str = "prob", threshold: float = 0.5) -> DataFrame:
    """Binary mask of a probability column."""
    return df.withColumn("mask", (F.col(probability) >= threshold).cast("int"))


def argmax_class(df: DataFrame, probabilities: str = "probs") -> DataFrame:
    """Index of the largest entry of a probability array, the first one on ties."""
    best = F.array_position(F.col(probabilities), F.array_max(probabilities)) - 1
    return df.withColumn("class", best.cast("int"))
