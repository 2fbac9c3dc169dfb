"""Hard negatives by slot-decomposed selection.

Every anchor's positives bring a window of scores each, and the windows of an
anchor overlap.  Their upper limits cut the scores into disjoint slots: slot j
holds the scores up to limit j and above limit j+1.  Each block of rows keeps
the best k rows of a slot, blocks merge slot by slot, and from the lowest slot
up the merged lists answer one window after the other; a lower limit only cuts
a list short.

Scores are integer inner products of floored vectors.  All anchors meet all
rows, block against block: rows are dealt to groups of bounded size, and packed
blocks of anchors are copied to each group, read in a stream.  Shorter vectors
count as filled up with zeros.

Rows with a null label, a null vector or a null or non-finite component take no
part.  A row is another row even if its id repeats; a null id is no anchor and
comes last among equal scores.  Other columns are not read.  Scores must fit 62
bits; beyond, the job fails with a message.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidelake.llm.batches import release_memory, shuffle_width
from slidelake.operators.grouping import map_sorted_groups
from slidelake.session import cut_lineage

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # percent of the positive's score
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 8192
GROUP_BYTES = 32 << 20  # of packed vectors; what a task holds at once
CELLS = 1 << 21  # scores that exist at once
_LAST_ID = (1 << 63) - 1  # a null id


# --- Packed blocks -----------------------------------------------------------------------------


def _narrow(values: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    for kind in (np.int8, np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return values.astype(kind)
    return values


def _save(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def _load(payload: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(payload)) as found:
        return {k: found[k] for k in found.files}


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Lists of integers as rows, filled up with zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(vectors), int(lengths.max()) if len(lengths) else 0), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def _pack(rows: DataFrame, limits: bool) -> DataFrame:
    """Blocks ``(block BIGINT, n BIGINT, bytes BIGINT, payload BINARY)`` of rows with ``place, vec_id, label, vector[, limits, least]``."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = TaskContext.get().partitionId() << 24
        for frame in frames:
            width = max(1, 8 * int(pa.compute.max(pa.compute.list_value_length(frame.column(3))).as_py() or 0))
            step = max(1, min(BLOCK_ROWS, BLOCK_BYTES // width))
            for at in range(0, frame.num_rows, step):
                part = frame.slice(at, step)
                arrays = {
                    "place": part.column(0).to_numpy(zero_copy_only=False),
                    "id": part.column(1).fill_null(_LAST_ID).to_numpy(zero_copy_only=False),
                    "label": part.column(2).to_numpy(zero_copy_only=False), "vector": _narrow(_matrix(part.column(3))),
                }
                if limits:
                    highs = part.column(4)
                    sizes = highs.value_lengths().to_numpy(zero_copy_only=False)
                    wide = int(sizes.max()) if len(sizes) else 0  # unused slots lie below all scores
                    table = np.full((part.num_rows, wide), np.iinfo(np.int64).min, np.int64)
                    table[np.arange(wide) < sizes[:, None]] = highs.flatten().to_numpy(zero_copy_only=False)
                    arrays |= {"limits": table, "least": part.column(5).to_numpy(zero_copy_only=False)}
                payload = _save(**arrays)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([count], pa.int64()), pa.array([part.num_rows], pa.int64()), pa.array([arrays["vector"].nbytes], pa.int64()), pa.array([payload], pa.binary())],
                    ["block", "n", "bytes", "payload"],
                )
                count += 1

    names = ["place", "vec_id", "label", "vector", *(["limits", "least"] if limits else [])]
    return rows.select(*names).mapInArrow(run, "block bigint, n bigint, bytes bigint, payload binary")


class _Rows:
    """The rows of one group, in the order of their ids."""

    def __init__(self, blocks: list[bytes]):
        parts = [_load(b) for b in blocks]
        wide = max(p["vector"].shape[1] for p in parts)
        self.vector = np.concatenate([np.pad(p["vector"], ((0, 0), (0, wide - p["vector"].shape[1]))) for p in parts])
        self.place, self.id, self.label = (np.concatenate([p[k] for p in parts]) for k in ("place", "id", "label"))
        order = np.lexsort((self.place, self.id))
        self.vector, self.place, self.id, self.label = self.vector[order], self.place[order], self.id[order], self.label[order]
        self.most = int(np.abs(self.vector.astype(np.int64)).max()) if self.vector.size else 0
        self.ready: dict[type, np.ndarray] = {}

    def scores(self, anchors: np.ndarray, columns: np.ndarray | None = None) -> np.ndarray:
        """Inner products as int64 or exact floats; one row per anchor."""
        wide = min(anchors.shape[1], self.vector.shape[1])
        most = int(np.abs(anchors.astype(np.int64)).max()) if anchors.size else 0
        bound = most * self.most * max(wide, 1)
        if bound >= 1 << 62:
            raise OverflowError("vectors are too large for integer scores of 62 bits")
        kind = np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64
        if kind not in self.ready:
            self.ready = {kind: np.ascontiguousarray(self.vector.T.astype(kind))}
        rows = self.ready[kind][:wide]
        return anchors[:, :wide].astype(kind) @ (rows if columns is None else rows[:, columns])


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Up to ``k`` times the highest allowed score of each row, first among equals: rows and columns."""
    lowest = -np.inf if scores.dtype.kind == "f" else np.iinfo(scores.dtype).min
    left = np.where(allowed, scores, lowest)
    lines = np.flatnonzero(allowed.any(axis=1))
    for _ in range(k):
        if not len(lines):
            return
        at = left[lines].argmax(axis=1) if len(lines) < len(left) else left.argmax(axis=1)
        found = left[lines, at] > lowest
        lines, at = lines[found], at[found]
        yield lines, at
        left[lines, at] = lowest


def _meet(rows: DataFrame, anchors: DataFrame, pick: Callable, names: list[str], schema: str) -> DataFrame:
    """Let every block of anchors meet every group of rows; ``pick(rows, anchors)`` gives a frame."""
    size = rows.agg(F.sum("bytes")).first()[0] or 0
    groups = max(shuffle_width(rows), -(-size // GROUP_BYTES))
    dealt = rows.select(F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("kind"), "payload")
    copied = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("kind"), "payload")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, held, ready = None, [], None
        for frame in frames:
            for number, kind, payload in zip(frame["group"], frame["kind"], frame["payload"]):
                if number != group:
                    group, held, ready = number, [], None
                    release_memory()
                if kind == 0:
                    held.append(payload)
                elif held or ready:
                    if ready is None:
                        ready, held = _Rows(held), []
                    block = _load(payload)
                    step = max(1, CELLS // len(ready.place))
                    for at in range(0, len(block["place"]), step):
                        out = [pd.DataFrame(dict(zip(names, f))) for f in pick(ready, {k: v[at : at + step] for k, v in block.items()})]
                        if out:
                            yield pd.concat(out)

    # A group's rows come before the anchors; both sides were written, so a repeated task sees the same.
    return dealt.unionByName(copied).repartitionById(groups, "group").sortWithinPartitions("group", "kind").mapInPandas(run, schema)


# --- The two selections ------------------------------------------------------------------------


def valid_rows(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """Rows that take part: ``(vec_id, label, vector)`` with floored components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return embeddings.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("vector"),
    )


def mine_hard_negatives(
    embeddings: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """For each anchor and each of its best rows of the same label, the best rows of other labels in the positive's window.

    ``embeddings(vec_id, embedding, label)``; ``is_anchor`` is asked of ``vec_id``.
    A window is ``low * positive <= 100 * negative <= high * positive``.  Gives
    ``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.
    """
    rows = cut_lineage(valid_rows(embeddings, scale).withColumn("place", F.monotonically_increasing_id()))
    blocks = cut_lineage(_pack(rows, False))
    chosen = rows.filter(F.coalesce(is_anchor, F.lit(False)))

    def nearest(group: _Rows, anchors: dict) -> Iterator[tuple]:
        for label in np.unique(anchors["label"]):
            mine, columns = np.flatnonzero(anchors["label"] == label), np.flatnonzero(group.label == label)
            if not len(columns):
                continue
            scores = group.scores(anchors["vector"][mine], columns)
            other = anchors["place"][mine][:, None] != group.place[columns][None, :]
            for line, at in _best(scores, other, positives):
                yield anchors["place"][mine[line]], scores[line, at].astype(np.int64), group.id[columns[at]]

    near = _meet(blocks, _pack(_few(chosen), False), nearest, ["anchor", "score", "id"], "anchor bigint, score bigint, id bigint")
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    windows = cut_lineage(
        near.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= positives).select(
            "anchor", F.col("_n").alias("slot"), "id", "score",
            F.expr(f"CAST(ceil(CAST({low} * CAST(score AS DECIMAL(38, 0)) AS DECIMAL(38, 0)) / 100) AS BIGINT)").alias("floor"),
            F.expr(f"CAST(floor(CAST({high} * CAST(score AS DECIMAL(38, 0)) AS DECIMAL(38, 0)) / 100) AS BIGINT)").alias("limit"),
        )
    )
    # A few numbers per anchor; limits fall with the slot.
    cuts = windows.groupBy(F.col("anchor").alias("place")).agg(
        F.sort_array(F.collect_list("limit"), asc=False).alias("limits"), F.min("floor").alias("least")
    )

    def hardest(group: _Rows, anchors: dict) -> Iterator[tuple]:
        scores = group.scores(anchors["vector"])
        limits = anchors["limits"]
        inside = (scores >= anchors["least"][:, None]) & (scores <= limits[:, :1]) & (anchors["label"][:, None] != group.label[None, :])
        columns = np.flatnonzero(inside.any(axis=0))
        if not len(columns):
            return
        scores, inside = scores[:, columns], inside[:, columns]
        for slot in range(limits.shape[1]):
            below = limits[:, slot + 1, None] if slot + 1 < limits.shape[1] else None
            allowed = inside & (scores <= limits[:, slot, None])
            if below is not None:
                allowed &= scores > below
            for line, at in _best(scores, allowed, negatives):
                yield anchors["place"][line], np.full(len(line), slot + 1, np.int32), scores[line, at].astype(np.int64), group.id[columns[at]]

    cut = _pack(_few(chosen.join(cuts, "place")), True)
    hits = _meet(blocks, cut, hardest, ["anchor", "slot", "score", "id"], "anchor bigint, slot int, score bigint, id bigint")
    inside = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    kept = hits.withColumn("_n", F.row_number().over(inside)).filter(F.col("_n") <= negatives).drop("_n")

    def answer(key: tuple, rows: Iterable) -> Iterable[tuple]:
        """From the lowest slot up: the best of all slots so far answer the slot's window."""
        wants: dict[int, tuple] = {}
        slots: dict[int, list] = {}
        for r in rows:
            if r.kind == 0:
                wants[r.slot] = (int(r.score), int(r.id), int(r.floor))
            else:
                slots.setdefault(r.slot, []).append((-int(r.score), int(r.id)))
        best: list[tuple] = []
        for slot in sorted(wants, reverse=True):
            best = heapq.nsmallest(negatives, best + slots.get(slot, []))
            score, positive, floor = wants[slot]
            for rank, (minus, negative) in enumerate((b for b in best if -b[0] >= floor), 1):
                yield key[0], positive, rank, negative, score, -minus

    both = windows.select("anchor", F.lit(0).alias("kind"), "slot", "score", "id", "floor").unionByName(
        kept.select("anchor", F.lit(1).alias("kind"), "slot", "score", "id", F.lit(0).cast("bigint").alias("floor"))
    )
    names = ["anchor", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    found = map_sorted_groups(
        both, ["anchor"], ["kind", "slot"], answer,
        "anchor bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint", names,
    )
    named = found.join(chosen.select(F.col("place").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    known = lambda c: F.when(F.col(c) != _LAST_ID, F.col(c)).alias(c)
    return named.select("anchor_id", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")


def _few(anchors: DataFrame) -> DataFrame:
    """Anchors in few partitions, so that their blocks are full."""
    count = anchors.count()
    return anchors.repartition(max(1, -(-count // BLOCK_ROWS)), "place")
