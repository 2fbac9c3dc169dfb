"""Bounded training samples, small models in numpy and scoring in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidelake.llm.batches import bytes_of, release_memory
from slidelake.llm.textops import splits

#: Texts above this many bytes are not used for fitting (they are scored like all others).
MAX_FIT_BYTES = 100_000
_DRAW = 1 << 30


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("bigint").cast("string").cast("binary")), F.lit(folds))


def sample_by_class(rows: DataFrame, label: str, per_class: int, total: int) -> DataFrame:
    """About ``per_class`` rows of every label value, drawn by a hash of ``doc_id``; ``total`` bounds all classes together.

    ``rows`` must be narrow (ids and labels) or a scan: it is read twice.  Adds
    ``_weight``, the rows of the class that one drawn row stands for.
    """
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), label).limit(total).collect()
    share = max(1, min(per_class, total // max(1, len(counts))))
    plan = [(r[label], min(_DRAW, _DRAW * share // r["n"]), max(1.0, r["n"] / share)) for r in counts]
    kind = rows.schema[label].dataType.simpleString()
    limits = rows.sparkSession.createDataFrame(plan, f"{label} {kind}, _limit bigint, _weight double")
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(_DRAW)) < F.col("_limit")
    return rows.join(F.broadcast(limits), label).filter(drawn).drop("_limit")  # at most ``total`` classes


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int) -> pa.Table:
    """Texts of a bounded, class-wise sample of labelled documents: ``text``, the label and ``_weight``.

    A document labelled more than once has the largest label; null ids and labels do not count.
    """
    rows = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias(label))
        .filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & usable)
        .groupBy("doc_id")
        .agg(F.max(label).alias(label))
    )
    # Twice the share and a hard limit below: the draw is by hash, so its size varies a little.
    ids = sample_by_class(rows, label, per_class, 2 * per_class).limit(3 * per_class)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter(
        F.octet_length("text") <= MAX_FIT_BYTES
    )
    return texts.join(F.broadcast(ids), "doc_id").orderBy("doc_id", "text").select("text", label, "_weight").toArrow()


class Vocabulary:
    """Known features by 64-bit hash; unknown ones map to ``size``."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.size = len(self.keys)
        # Marks the low bits in use, so that most unknown features need no search.
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.size, np.int64)
        maybe = np.flatnonzero(self.seen[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        if self.size and len(maybe):
            at = np.minimum(np.searchsorted(self.keys, hashes[maybe]), self.size - 1)
            good = self.keys[at] == hashes[maybe]
            out[maybe[good]] = at[good]
        return out


class Adam:
    """Adam steps on one parameter vector."""

    def __init__(self, size: int, rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = np.zeros(size), np.zeros(size)

    def step(self, w: np.ndarray, grad: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.01 * (grad * grad - self.v)
        w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[np.ndarray, np.ndarray], dict[str, object]]],
    schema: str,
    slice_bytes: int = 1 << 20,
) -> DataFrame:
    """Apply a function of buffer and offsets to slices of whole texts; gives ``doc_id`` and the returned columns.

    ``make`` builds the function once per task, from broadcast arrays for example.

    Only ``doc_id`` and ``text`` are read, so other columns cannot clash.
    """

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for piece in arrow:
            buf, offsets = bytes_of(piece.column(1))
            for begin, end in splits(np.diff(offsets), slice_bytes):
                part = offsets[begin : end + 1]
                got = score(buf[part[0] : part[-1]], part - part[0])
                columns = [piece.column(0).slice(begin, end - begin)]
                columns += [v if isinstance(v, pa.Array) else pa.array(v) for v in got.values()]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *got])
            release_memory()

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, f"doc_id bigint, {schema}")


def concat_texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = table["text"].combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    return bytes_of(column)


def pieces(table: pa.Table, limit: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Slices of a sample's texts with the number of their first text, so that fitting needs little memory at once."""
    buf, offsets = concat_texts(table)
    for begin, end in splits(np.diff(offsets), limit):
        part = offsets[begin : end + 1]
        yield buf[part[0] : part[-1]], part - part[0], begin
