"""Coordinate spaces and packed tile keys.

*slide* px are full-resolution pyramid pixels, *level* px are slide px divided
by the level's downsample, *WSI* px are pixels of the original scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_level(value: Column, downsample: Column) -> Column:
    """Slide px to level px."""
    return value / downsample.cast("double")


def to_slide(value: Column, downsample: Column) -> Column:
    """Level px to slide px."""
    return value * downsample.cast("double")


def slide_to_wsi_scale(target_mpp: Column, source_mpp: Column) -> Column:
    """Slide px to WSI px factor; 1 when the source resolution is not positive."""
    return F.when(source_mpp > 0, target_mpp / source_mpp).otherwise(F.lit(1.0))


def to_wsi(value: Column, target_mpp: Column, source_mpp: Column) -> Column:
    """Slide px to WSI px."""
    return value * slide_to_wsi_scale(target_mpp, source_mpp)


def level_tile_side(tile_size: Column, downsample: Column) -> Column:
    """Side of one tile of a level, in slide px."""
    return tile_size.cast("bigint") * downsample.cast("bigint")


def tile_key(level: Column, col: Column, row: Column) -> Column:
    """Pack level, column and row into one BIGINT of 16, 24 and 24 bits."""
    return (
        F.shiftleft(level.cast("bigint"), 48)
        .bitwiseOR(F.shiftleft(col.cast("bigint"), 24))
        .bitwiseOR(row.cast("bigint"))
    )


def tile_key_parts(key: Column) -> Column:
    """Inverse of :func:`tile_key` as a struct."""
    low24 = F.lit(0xFFFFFF).cast("bigint")
    return F.struct(
        F.shiftrightunsigned(key, 48).cast("int").alias("level"),
        F.shiftrightunsigned(key, 24).bitwiseAND(low24).cast("int").alias("col"),
        key.bitwiseAND(low24).cast("int").alias("row"),
    )
