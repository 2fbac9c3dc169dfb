"""Label images as runs: tiles whose rows are stretches of one value.

A run tile has ``slide_id, col, row, width, height`` and three arrays of one
length: ``starts`` (packed image position ``y << 32 | x`` of the first pixel),
``lengths`` (pixels to the right, within the tile) and ``vals``.  Runs are
sorted by position and do not overlap.  Tiles meet tiles; what leaves a tile is a
small row per label, never a pixel.  Stored with
``write_tile_store(runs, keys=PLACE)``, run tiles of one layout join in place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.operators.cells import pick_types
from slidelake.operators.components import label_tiles
from slidelake.operators.skew import salted_join
from slidelake.session import cut_lineage

PLACE = ["slide_id", "col", "row"]
RUNS = ["starts", "lengths", "vals"]
_LOW = 0xFFFFFFFF


def _sid(df: DataFrame) -> str:
    return f"slide_id {df.schema['slide_id'].dataType.simpleString()}"


def _find_runs(values: np.ndarray, off: int | None, x0: int, y0: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed starts, lengths and values of the runs of a tile at ``(x0, y0)``."""
    h, w = values.shape
    fresh = np.ones((h, w), bool)
    fresh[:, 1:] = values[:, 1:] != values[:, :-1]
    at = np.flatnonzero(fresh)
    lengths = np.diff(np.append(at, h * w))
    found = values.ravel()[at].astype(np.int64)
    y, x = np.divmod(at, max(w, 1))
    starts = ((y + y0).astype(np.int64) << 32) | (x + x0)
    if off is not None:
        kept = found != off
        starts, lengths, found = starts[kept], lengths[kept], found[kept]
    return starts, lengths.astype(np.int32), found


def tile_runs(
    tiles: DataFrame, tile_size: int, payload: str = "labels", dtype: str = "<i8", off: int | None = -1
) -> DataFrame:
    """Run tiles of tiles with one ``dtype`` value per pixel in ``payload``.

    Pixels of the value ``off`` belong to no run; ``None`` keeps every value.  A
    tile without payload has no runs; payload of a wrong size is an error.
    """
    names = [*PLACE, "width", "height", *RUNS]

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf.itertuples(index=False):
                shape = (0, t.width) if t.payload is None else (t.height, t.width)
                values = np.frombuffer(t.payload or b"", dtype).reshape(shape)
                out.append((*t[:5], *_find_runs(values, off, t.col * tile_size, t.row * tile_size)))
            yield pd.DataFrame(out, columns=names)

    return tiles.select(*PLACE, "width", "height", F.col(payload).alias("payload")).mapInPandas(
        convert,
        f"{_sid(tiles)}, col int, row int, width int, height int, "
        "starts array<bigint>, lengths array<int>, vals array<bigint>",
    )


def label_runs(mask_tiles: DataFrame, tile_size: int) -> DataFrame:
    """Run tiles of the 4-connected components of tiled masks."""
    return tile_runs(label_tiles(mask_tiles, tile_size), tile_size)


def run_pixels(runs: DataFrame, value: str = "label") -> DataFrame:
    """Runs as a pixel table ``(slide_id, x, y, value)``, for those who need one."""
    each = runs.select("slide_id", F.explode(F.arrays_zip(*RUNS)).alias("r"))
    x = F.col("r.starts").bitwiseAND(F.lit(_LOW).cast("bigint"))
    return each.select(
        "slide_id", F.explode(F.sequence(x, x + F.col("r.lengths") - 1)).alias("x"),
        F.shiftright("r.starts", 32).alias("y"), F.col("r.vals").alias(value),
    )


def _tile_sums(runs: DataFrame) -> DataFrame:
    """One row per tile and label: pixels, bounds, coordinate sums, and whether it reaches the tile's edge."""
    names = ["slide_id", "col", "row", "label", "n", "row_min", "row_max", "col_min", "col_max", "sum_x", "sum_y", "at_edge"]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tile = np.repeat(np.arange(len(pdf)), pdf["starts"].map(len).to_numpy(np.int64))
            if not len(tile):
                continue
            starts, n, vals = (np.concatenate(pdf[c].to_numpy()).astype(np.int64) for c in RUNS)
            y, x = starts >> 32, starts & _LOW
            order = np.lexsort((vals, tile))
            tile, label = tile[order], vals[order]
            first = np.flatnonzero(np.concatenate(([True], (tile[1:] != tile[:-1]) | (label[1:] != label[:-1]))))
            add = lambda v: np.add.reduceat(v[order], first)
            low = lambda v: np.minimum.reduceat(v[order], first)
            high = lambda v: np.maximum.reduceat(v[order], first)
            box = low(y), high(y) + 1, low(x), high(x + n)
            own = pdf.iloc[tile[first]]
            col, row, width, height, size = (own[c].to_numpy(np.int64) for c in ("col", "row", "width", "height", "size"))
            # Edges as far as this tile reaches, so ragged tiles count too.
            top, left = row * size, col * size
            edge = (box[0] == top) | (box[1] == top + height) | (box[2] == left) | (box[3] == left + width)
            yield pd.DataFrame(dict(zip(names, (
                own["slide_id"].to_numpy(), col, row, label[first], add(n), *box, add(n * x + n * (n - 1) // 2), add(n * y), edge,
            ))))

    return runs.mapInPandas(
        sums,
        f"{_sid(runs)}, col int, row int, label bigint, n bigint, row_min bigint, row_max bigint, "
        "col_min bigint, col_max bigint, sum_x bigint, sum_y bigint, at_edge boolean",
    )


def _sized(runs: DataFrame, tile_size: int) -> DataFrame:
    return runs.select(*PLACE, "width", "height", *RUNS, F.lit(tile_size).alias("size"))


def run_instances(runs: DataFrame, tile_size: int) -> DataFrame:
    """Bounding box (high ends exclusive), area and centroid of each label of run tiles."""
    return _tile_sums(_sized(runs, tile_size)).groupBy("slide_id", "label").agg(
        F.min("row_min").alias("row_min"), F.max("row_max").alias("row_max"),
        F.min("col_min").alias("col_min"), F.max("col_max").alias("col_max"),
        F.sum("n").alias("area"),
        (F.sum("sum_x") / F.sum("n")).alias("cx"), (F.sum("sum_y") / F.sum("n")).alias("cy"),
    )


def remove_small_runs(runs: DataFrame, tile_size: int, min_size: int = 10) -> DataFrame:
    """Run tiles without the components of fewer than ``min_size`` pixels.

    Labels are 4-connected components, so one that stays off its tile's edges
    lies in no other tile and is judged there.  Only labels at an edge are added
    up across tiles; back to a tile goes the list of those to drop, which is no
    longer than its border.
    """
    if min_size <= 0:
        return runs
    # Runs are counted and then thinned out: written once, so that they are made once.
    runs = cut_lineage(runs.select(*PLACE, "width", "height", *RUNS))
    counted = cut_lineage(_tile_sums(_sized(runs, tile_size)).filter("at_edge").select(*PLACE, "label", "n"))
    small = counted.groupBy("slide_id", "label").agg(F.sum("n").alias("total")).filter(F.col("total") < min_size)
    drops = (
        salted_join(counted.filter(F.col("n") < min_size), small.drop("total"), ["slide_id", "label"])
        .groupBy(*PLACE).agg(F.collect_list("label").alias("drop"))
    )
    names = [*PLACE, "width", "height", *RUNS]

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf.itertuples(index=False):
                starts, lengths, vals = np.asarray(t.starts), np.asarray(t.lengths), np.asarray(t.vals)
                if len(starts):
                    y, x = starts >> 32, starts & _LOW
                    top, left = t.row * tile_size, t.col * tile_size
                    edge = (y == top) | (y == top + t.height - 1) | (x == left) | (x + lengths == left + t.width)
                    label, at = np.unique(vals, return_inverse=True)
                    inside = np.bincount(at, edge) == 0
                    gone = inside & (np.bincount(at, lengths) < min_size)
                    if t.drop is not None and len(t.drop):
                        gone |= np.isin(label, t.drop)
                    kept = ~gone[at]
                    starts, lengths, vals = starts[kept], lengths[kept], vals[kept]
                out.append((*t[:5], starts, lengths, vals))
            yield pd.DataFrame(out, columns=names)

    return runs.select(*names).join(drops, PLACE, "left").mapInPandas(
        keep, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in runs.select(*names).schema)
    )


def _overlaps(a_starts, a_lengths, a_vals, b_starts, b_lengths, b_vals) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Common pixels of two run lists, summed by pair of values."""
    a_ends, b_ends = a_starts + a_lengths, b_starts + b_lengths
    low = np.searchsorted(b_ends, a_starts, "right")
    n = np.maximum(np.searchsorted(b_starts, a_ends, "left") - low, 0)
    a = np.repeat(np.arange(len(a_starts)), n)
    b = np.repeat(low - np.cumsum(n) + n, n) + np.arange(len(a))
    common = np.minimum(a_ends[a], b_ends[b]) - np.maximum(a_starts[a], b_starts[b])
    pairs, at = np.unique(np.stack([a_vals[a], b_vals[b]]), axis=1, return_inverse=True)
    return pairs[0], pairs[1], np.bincount(at.ravel(), common, pairs.shape[1]).astype(np.int64)


def overlap_counts(runs: DataFrame, classes: DataFrame) -> DataFrame:
    """Common pixels ``n`` of every label and class, from run tiles of one tile layout."""
    other = classes.select(*PLACE, *[F.col(c).alias(f"other_{c}") for c in RUNS])
    met = runs.select(*PLACE, *RUNS).join(other, PLACE)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [
                (t.slide_id, *_overlaps(*[np.asarray(c, np.int64) for c in t[3:]]))
                for t in pdf.itertuples(index=False) if len(t.starts) and len(t.other_starts)
            ]
            if found:
                slide, *sums = zip(*found)
                label, kind, n = map(np.concatenate, sums)
                yield pd.DataFrame({"slide_id": np.repeat(slide, [len(c) for c in sums[0]]), "label": label, "type": kind, "n": n})

    parts = met.mapInPandas(count, f"{_sid(runs)}, label bigint, type bigint, n bigint")
    return parts.groupBy("slide_id", "label", "type").agg(F.sum("n").alias("n"))


def run_types(runs: DataFrame, classes: DataFrame) -> DataFrame:
    """Most frequent class of each label and its share, as ``instance_types`` gives them."""
    return pick_types(overlap_counts(runs, classes))
