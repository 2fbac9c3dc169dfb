"""Tile lookup and region assembly."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidelake.operators.grouping import map_sorted_groups
from slidelake.operators.ordering import explode_range
from slidelake.operators.skew import salted_join, shuffled

TILE = ["slide_id", "level", "col", "row"]


def tiles_in_roi(tiles: DataFrame, rois: DataFrame, levels: DataFrame) -> DataFrame:
    """Stored tiles intersecting each ROI at its level; touching edges do not count.

    The rectangle becomes a tile range first, so the join is an equi-join on the
    tile key and never compares all tiles of a slide.
    """
    known = levels.select("slide_id", "level", "downsample", "cols", "rows", "tile_size")
    side = (F.col("tile_size").cast("bigint") * F.col("downsample")).cast("double")
    zero = F.lit(0).cast("bigint")
    ranged = salted_join(rois, known, ["slide_id", "level"]).select(
        *rois.columns,
        F.greatest(zero, F.floor(F.col("x") / side)).alias("_c0"),
        F.least(F.col("cols").cast("bigint"), F.ceil((F.col("x") + F.col("w")) / side)).alias("_c1"),
        F.greatest(zero, F.floor(F.col("y") / side)).alias("_r0"),
        F.least(F.col("rows").cast("bigint"), F.ceil((F.col("y") + F.col("h")) / side)).alias("_r1"),
    )
    rows = explode_range(ranged, F.col("_r0"), F.col("_r1"), "row")
    cells = explode_range(rows, F.col("_c0"), F.col("_c1"), "col").drop("_c0", "_c1", "_r0", "_r1")
    return cells.join(shuffled(tiles), TILE)


def get_tiles(requests: DataFrame, tiles: DataFrame) -> DataFrame:
    """Point lookup; tiles outside the grid or of length 0 come back as null."""
    stored = tiles.filter(F.col("length") > 0) if "length" in tiles.columns else tiles
    return requests.join(shuffled(stored), TILE, "left")


def _floor_div(value: Column, by: Column) -> Column:
    return F.floor(value / by).cast("bigint")


def assemble_regions(
    requests: DataFrame, tiles: DataFrame, tile_size: int, block_pixels: int = 1 << 24
) -> DataFrame:
    """Pixels of level-px rectangles; parts without a tile stay white.

    A region wider or taller than ``block_pixels`` allows is returned as several
    row blocks (``block``, ``y_offset``), so no task holds more than one block;
    smaller regions are exactly one row.  Tiles are cropped to the part a block
    needs before the shuffle.
    """
    size = F.lit(tile_size)
    checked = requests.withColumn(
        "w",
        F.when((F.col("w") > 0) & (F.col("h") > 0), F.col("w")).otherwise(
            F.raise_error(F.lit("region width and height must be positive")).cast("int")
        ),
    )
    tall = F.greatest(F.lit(1), F.floor(F.lit(block_pixels) / F.col("w"))).cast("bigint")
    blocks = explode_range(
        checked.withColumn("_tall", tall), F.lit(0), F.ceil(F.col("h") / F.col("_tall")), "block"
    ).select(
        "request_id", "slide_id", "level", "block",
        F.col("x").cast("bigint").alias("x"),
        (F.col("block") * F.col("_tall")).alias("y_offset"),
        F.col("w").cast("bigint").alias("bw"),
        F.least(F.col("_tall"), F.col("h") - F.col("block") * F.col("_tall")).alias("bh"),
        F.col("y").cast("bigint").alias("_y"),
    ).withColumn("by", F.col("_y") + F.col("y_offset")).drop("_y")
    rows = explode_range(
        blocks.filter(F.col("level") >= 0),
        F.greatest(F.lit(0), _floor_div(F.col("by"), size)),
        _floor_div(F.col("by") + F.col("bh") - 1, size) + 1,
        "row",
    )
    cells = explode_range(
        rows,
        F.greatest(F.lit(0), _floor_div(F.col("x"), size)),
        _floor_div(F.col("x") + F.col("bw") - 1, size) + 1,
        "col",
    )
    payload = tiles.select(*TILE, F.col("width").alias("tw"), F.col("height").alias("th"), "rgb")
    hits = cells.join(payload, TILE)  # by the whole tile key, so the pixels of a tile store do not move

    def crop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                tx, ty = r.col * tile_size, r.row * tile_size
                left, right = max(r.x, tx), min(r.x + r.bw, tx + r.tw)
                top, bottom = max(r.by, ty), min(r.by + r.bh, ty + r.th)
                if left >= right or top >= bottom:
                    continue
                image = np.frombuffer(r.rgb, np.uint8).reshape(r.th, r.tw, 3)
                part = image[top - ty:bottom - ty, left - tx:right - tx]
                out.append((r.request_id, r.block, r.y_offset, r.bw, r.bh, left - r.x, top - r.by,
                            right - left, bottom - top, part.tobytes()))
            yield pd.DataFrame(out, columns=names)

    id_type = requests.schema["request_id"].dataType.simpleString()
    names = ["request_id", "block", "y_offset", "bw", "bh", "dx", "dy", "pw", "ph", "part"]
    piece_schema = (
        f"request_id {id_type}, block int, y_offset bigint, bw bigint, bh bigint, "
        "dx bigint, dy bigint, pw bigint, ph bigint, part binary"
    )
    pieces = hits.select(
        "request_id", "block", "y_offset", "bw", "bh", "x", "by", "col", "row", "tw", "th", "rgb"
    ).mapInPandas(crop, piece_schema)
    frames = blocks.select("request_id", "block", "y_offset", "bw", "bh")

    def paste(key: tuple, rows: Iterable) -> Iterable[tuple]:
        canvas = None
        for r in rows:
            if canvas is None:
                canvas = np.full((int(r.bh), int(r.bw), 3), 255, np.uint8)
                y_offset = int(r.y_offset)
            if r.part is None:
                continue
            dx, dy, pw, ph = int(r.dx), int(r.dy), int(r.pw), int(r.ph)
            canvas[dy:dy + ph, dx:dx + pw] = np.frombuffer(r.part, np.uint8).reshape(ph, pw, 3)
        yield (*key, y_offset, canvas.shape[1], canvas.shape[0], canvas.tobytes())

    return map_sorted_groups(
        frames.unionByName(pieces, allowMissingColumns=True), ["request_id", "block"], [], paste,
        f"request_id {id_type}, block int, y_offset bigint, width int, height int, rgb binary",
        ["request_id", "block", "y_offset", "width", "height", "rgb"],
    )
