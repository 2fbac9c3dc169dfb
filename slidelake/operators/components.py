"""Connected components of a mask that spans many tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.session import cut_lineage


def _label_tile(mask: np.ndarray) -> np.ndarray:
    """Smallest member index of each pixel's 4-connected component, -1 off the mask.

    Propagates minima along runs by rows and columns until nothing changes.
    """
    h, w = mask.shape
    big = h * w
    labels = np.where(mask, np.arange(big).reshape(h, w), big)
    # Run numbers: a run ends at every unset pixel, so minima stay inside it.
    runs_x = np.cumsum(~mask, axis=1) + np.arange(h)[:, None] * (w + 1)
    runs_y = np.cumsum(~mask, axis=0) + np.arange(w)[None, :] * (h + 1)
    while True:
        before = labels.copy()
        for runs in (runs_x, runs_y):
            low = np.full(runs.max() + 1, big)
            np.minimum.at(low, runs[mask], labels[mask])
            labels[mask] = low[runs[mask]]
        if np.array_equal(before, labels):
            return np.where(mask, labels, -1)


def merge_labels(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Smallest reachable node for every node of an undirected edge list ``(a, b)``.

    Alternates the large-star and small-star steps, which need a number of
    rounds that grows with the logarithm of the longest chain.  Each step is a
    grouped minimum (combined before the shuffle) and a join, whose crowded nodes
    adaptive execution splits over tasks; every round is written out.  Stops when a round changes nothing and fails loudly if it
    never does.
    """
    def star(links: DataFrame, large: bool) -> DataFrame:
        # links are (node, peer), one direction per step
        low = links.groupBy("node").agg(F.min(F.least("node", "peer")).alias("low"))
        joined = links.join(low, "node")
        if large:
            return joined.filter(F.col("peer") > F.col("node")).select(
                F.col("peer").alias("a"), F.col("low").alias("b")
            )
        moved = joined.select(F.col("peer").alias("a"), F.col("low").alias("b"))
        return moved.unionByName(low.select(F.col("node").alias("a"), F.col("low").alias("b")))

    def both_ways(pairs: DataFrame) -> DataFrame:
        return pairs.select(
            F.explode(
                F.array(
                    F.struct(F.col("a").alias("node"), F.col("b").alias("peer")),
                    F.struct(F.col("b").alias("node"), F.col("a").alias("peer")),
                )
            ).alias("l")
        ).select("l.node", "l.peer")

    def downward(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("peer"))

    def clean(pairs: DataFrame) -> DataFrame:
        ordered = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        return ordered.filter("a <> b").distinct()

    current = cut_lineage(clean(edges))
    mark = _fingerprint(current)
    for _ in range(max_rounds):
        large = clean(star(both_ways(current), True))
        current = cut_lineage(clean(star(downward(large), False)))
        now = _fingerprint(current)
        if now == mark:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now
    raise RuntimeError("component merging did not settle")


def _fingerprint(pairs: DataFrame) -> tuple:
    return tuple(
        pairs.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))
        ).first()
    )


def _local_labels(mask_tiles: DataFrame, tile_size: int) -> DataFrame:
    """Label each tile on its own; keep the labels along its borders beside them.

    A label is the packed position ``y << 32 | x`` of the component's first
    pixel, so it also tells which tile it belongs to.
    """
    sid = mask_tiles.schema["slide_id"].dataType.simpleString()
    names = ["slide_id", "col", "row", "width", "height", "labels", "left", "right", "top", "bottom"]

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf.itertuples(index=False):
                mask = np.frombuffer(t.mask, np.uint8).reshape(t.height, t.width) > 0
                low = _label_tile(mask).astype(np.int64)
                y, x = low // t.width + t.row * tile_size, low % t.width + t.col * tile_size
                labels = np.where(mask, (y << 32) | x, -1)
                out.append((t.slide_id, t.col, t.row, t.width, t.height, labels.tobytes(),
                            labels[:, 0], labels[:, -1], labels[0], labels[-1]))
            yield pd.DataFrame(out, columns=names)

    return mask_tiles.select("slide_id", "col", "row", "width", "height", "mask").mapInPandas(
        label,
        f"slide_id {sid}, col int, row int, width int, height int, labels binary, left array<bigint>, "
        "right array<bigint>, top array<bigint>, bottom array<bigint>",
    )


def _touching(local: DataFrame) -> DataFrame:
    """Pairs of labels that meet across a border of two neighbouring tiles."""
    def side(name: str, turn: int, dx: int, dy: int) -> DataFrame:
        return local.select(
            "slide_id", F.lit(turn).alias("turn"), (F.col("col") + dx).alias("col"), (F.col("row") + dy).alias("row"),
            F.posexplode(name).alias("at", "label"),
        ).filter(F.col("label") >= 0)

    ends = side("right", 0, 1, 0).unionByName(side("bottom", 1, 0, 1)).withColumnRenamed("label", "other")
    starts = side("left", 0, 0, 0).unionByName(side("top", 1, 0, 0))
    pairs = starts.join(ends, ["slide_id", "turn", "col", "row", "at"])
    # Labels are unique per slide only, so a node is the pair of slide and label.
    node = lambda label: F.struct(F.col("slide_id").alias("s"), F.col(label).alias("l"))
    return pairs.select(node("label").alias("a"), node("other").alias("b"))


def label_tiles(mask_tiles: DataFrame, tile_size: int) -> DataFrame:
    """Component labels of tiled masks, one array of BIGINT labels per tile (-1 off the mask).

    ``mask_tiles(slide_id, col, row, width, height, mask BINARY)`` holds one byte
    per pixel.  Tiles are labelled on their own; only labels along tile borders
    take part in the merging, and a tile's pixels move at most once, to meet the
    final names of its border labels.
    """
    sid = mask_tiles.schema["slide_id"].dataType.simpleString()
    local = cut_lineage(_local_labels(mask_tiles, tile_size))
    roots = merge_labels(_touching(local)).select(
        F.col("node.s").alias("slide_id"), F.col("node.l").alias("label"), F.col("root.l").alias("root")
    )
    home = lambda part: F.floor(part / F.lit(tile_size)).cast("int")
    # A tile has at most as many renamed labels as border pixels.
    renames = roots.groupBy(
        "slide_id",
        home(F.col("label").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))).alias("col"),
        home(F.shiftright("label", 32)).alias("row"),
    ).agg(F.collect_list("label").alias("before"), F.collect_list("root").alias("after"))
    names = ["slide_id", "col", "row", "width", "height", "labels"]

    def rename(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf.itertuples(index=False):
                labels = t.labels
                if t.before is not None and len(t.before):
                    order = np.argsort(t.before)
                    before, after = np.asarray(t.before)[order], np.asarray(t.after)[order]
                    flat = np.frombuffer(labels, np.int64).copy()
                    at = np.minimum(np.searchsorted(before, flat), len(before) - 1)
                    known = before[at] == flat
                    flat[known] = after[at[known]]
                    labels = flat.tobytes()
                out.append((t.slide_id, t.col, t.row, t.width, t.height, labels))
            yield pd.DataFrame(out, columns=names)

    joined = local.select(*names).join(renames, ["slide_id", "col", "row"], "left")
    return joined.mapInPandas(rename, f"slide_id {sid}, col int, row int, width int, height int, labels binary")


def label_components(mask_tiles: DataFrame, tile_size: int) -> DataFrame:
    """Labels of the 4-connected components as a pixel table ``(slide_id, x, y, label)``."""
    sid = mask_tiles.schema["slide_id"].dataType.simpleString()

    def pixels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for t in pdf.itertuples(index=False):
                labels = np.frombuffer(t.labels, np.int64).reshape(t.height, t.width)
                ys, xs = np.nonzero(labels >= 0)
                found.append((xs + t.col * tile_size, ys + t.row * tile_size, labels[ys, xs]))
            x, y, label = map(np.concatenate, zip(*found)) if found else [np.zeros(0, np.int64)] * 3
            slide = pdf["slide_id"].repeat([len(c) for c, *_ in found])
            for a in range(0, len(x), 1 << 20):  # a row per pixel, some at a time
                at = slice(a, a + (1 << 20))
                yield pd.DataFrame({"slide_id": slide.iloc[at].to_numpy(), "x": x[at], "y": y[at], "label": label[at]})

    return label_tiles(mask_tiles, tile_size).mapInPandas(
        pixels, f"slide_id {sid}, x bigint, y bigint, label bigint"
    )
