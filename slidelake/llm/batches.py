"""Documents packed into batches of a few megabytes, written once to the shared folder.

Every row of a packed table is one batch: a number and a compressed Arrow
stream of ``doc_id`` and the UTF-8 bytes of ``text`` (null: empty).  A document
is named by its place, ``batch << 16 | index``, so null or repeated ids need no
special care.  Batches are written before they are used, so a lost executor
cannot change the numbering; they lie in buckets by number, so that what is
told to a batch moves to it and its texts stay where they are.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.session import cut_to_buckets

BATCH_BYTES = 4 << 20
MAX_ROWS = 1 << 16  # a place holds 16 bits of index


class Batch:
    """Buffer, offsets and ids of one batch."""

    def __init__(self, number: int, payload: bytes):
        table = pa.ipc.open_stream(payload).read_all().combine_chunks()
        self.number = int(number)
        self.rows = table.num_rows
        self.table = table
        self.ids = table["doc_id"].combine_chunks() if self.rows else pa.array([], pa.int64())
        if isinstance(self.ids, pa.ChunkedArray):
            self.ids = self.ids.chunk(0)
        text = table["text"].combine_chunks() if self.rows else pa.array([], pa.large_binary())
        if isinstance(text, pa.ChunkedArray):
            text = text.chunk(0)
        self.buf, self.offsets = bytes_of(text)

    @property
    def places(self) -> np.ndarray:
        return (self.number << 16) + np.arange(self.rows, dtype=np.int64)

    @property
    def nulls(self) -> np.ndarray:
        """Which texts are null; only known where all columns were packed."""
        return self.table["null_text"].to_numpy(zero_copy_only=False) if "null_text" in self.table.column_names else np.zeros(self.rows, bool)

    def rest(self) -> pa.Table:
        """The other columns, where they were packed."""
        kept = [c for c in self.table.column_names if c.startswith("carry_")]
        return self.table.select(kept).rename_columns([c[len("carry_"):] for c in kept])

    def text(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()


def bytes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Byte buffer and int64 offsets of a text or binary array; null counts as empty."""
    text = text.cast(pa.large_binary()).fill_null(b"")
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = text.buffers()
    offsets = np.frombuffer(where, np.int64)[text.offset : text.offset + len(text) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(text) + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return buf, offsets - offsets[0]


def _write(parts: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    table = pa.Table.from_batches(parts).combine_chunks()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def pack(docs: DataFrame, batch_bytes: int = BATCH_BYTES, carry: bool = False) -> DataFrame:
    """Written table ``(batch BIGINT, rows BIGINT, payload BINARY)`` of all documents.

    Other columns are left out, or travel along under ``carry_`` names.
    """
    others = docs.columns if carry else []

    def fold(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 20
        held: list[pa.RecordBatch] = []
        size = rows = count = 0

        def flush():
            nonlocal held, size, rows, count
            out = pa.RecordBatch.from_arrays(
                [pa.array([base + count], pa.int64()), pa.array([rows], pa.int64()), pa.array([_write(held)], pa.binary())],
                ["batch", "rows", "payload"],
            )
            held, size, rows, count = [], 0, 0, count + 1
            return out

        for piece in arrow:
            lengths = np.diff(bytes_of(piece.column(1))[1])
            arrays = [piece.column(0), piece.column(1).cast(pa.large_binary()).fill_null(b"")]
            fields = ["doc_id", "text"]
            if others:
                arrays += [piece.column(1).is_null(), *piece.columns[2:]]
                fields += ["null_text", *(f"carry_{c}" for c in others if c != "text")]
            data = pa.RecordBatch.from_arrays(arrays, fields)
            begin = 0
            for i, n in enumerate(lengths.tolist()):
                many = rows + i - begin
                if many >= MAX_ROWS or (many and size + n > batch_bytes):
                    held.append(data.slice(begin, i - begin))
                    rows += i - begin
                    yield flush()
                    begin = i
                size += n
            held.append(data.slice(begin))
            rows += len(lengths) - begin
        if rows:
            yield flush()

    narrow = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
        *[F.col(c).alias(f"carry_{c}") for c in others if c != "text"],
    )
    return cut_to_buckets(narrow.mapInArrow(fold, "batch bigint, rows bigint, payload binary"), "batch")


def documents_of(batch: Batch, names: list[str], texts: pa.Array | None = None) -> pa.Table:
    """All columns of a batch that was packed with them; ``texts`` takes the place of the packed ones."""
    rest = batch.rest()
    if texts is None:
        texts = batch.table["text"].cast(pa.large_string())
        texts = pa.compute.if_else(batch.table["null_text"], pa.scalar(None, pa.large_string()), texts)
    return pa.table([texts.cast(pa.string()) if n == "text" else rest[n] for n in names], names)


def select_places(docs: DataFrame, packed: DataFrame, places: DataFrame, keep: bool) -> DataFrame:
    """The packed rows of ``docs`` whose ``place`` is listed, or all others."""
    names = docs.columns

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in arrow:
            for number, payload, listed in zip(*(frame.column(k).to_pylist() for k in range(3))):
                batch = Batch(number, payload)
                mask = np.isin(batch.places, np.array(listed or [], np.int64)) == keep
                yield from documents_of(batch, names).filter(pa.array(mask)).to_batches()

    # A batch has some ten thousand places at most.
    marks = places.groupBy(F.shiftright("place", 16).alias("batch")).agg(F.collect_list("place").alias("listed"))
    joined = packed.select("batch", "payload").join(marks, "batch", "inner" if keep else "left")
    return joined.select("batch", "payload", "listed").mapInArrow(run, docs.schema)


def release_memory() -> None:
    """Give freed memory back to the system; reused workers would else keep their peak."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def each_batch(frames: Iterator[pd.DataFrame]) -> Iterator[Batch]:
    """Batches of a packed table inside mapInPandas."""
    for frame in frames:
        for number, payload in zip(frame["batch"], frame["payload"]):
            yield Batch(number, payload)
            release_memory()


def shuffle_width(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
