"""Big files written from ordered pieces, on any file system, with a commit protocol.

Tasks write parts under names of their own in a staging folder and report them;
only reported parts of a finished job count, so a task that was lost, repeated or
run twice leaves nothing in the result.  A file of one part is moved into place,
one of several is joined in its own task and moved then, so that readers see a
file whole or not at all.  A job that fails takes its staging folder with it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from slidelake.sources.files import open_store

FORMAT = "slidelake_pieces"
_MANIFEST = "parts.parquet"  # a name that Spark does not take for a hidden file
_COPY_BYTES = 8 << 20


@dataclass
class Parts(WriterCommitMessage):
    """Parts of one task: file, block, staged name, bytes."""

    rows: list[tuple[str, int, str, int]]


class PieceWriter(DataSourceArrowWriter):
    """Appends the pieces of each run of ``(file, block)`` to one staged part."""

    def __init__(self, options: dict[str, str]):
        self.staging = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        store, base = open_store(self.staging)
        attempt = uuid.uuid4().hex
        rows: list[tuple[str, int, str, int]] = []
        key, out, size = None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                rows.append((*key, name, size))

        name = ""
        try:
            for frame in iterator:
                for file, block, data in zip(*(frame.column(k) for k in ("file", "block", "data"))):
                    if (file.as_py(), block.as_py()) != key:
                        close()
                        key, size, name = (file.as_py(), block.as_py()), 0, f"{attempt}-{len(rows):06d}"
                        store.create_dir(base, recursive=True)
                        out = store.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(data.as_buffer())
                    size += len(data.as_buffer())
            close()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
                store.delete_file(f"{base}/{name}")
            for *_, done, _ in rows:
                store.delete_file(f"{base}/{done}")
            raise
        return Parts(rows)

    def commit(self, messages: list[Parts | None]) -> None:
        store, base = open_store(self.staging)
        found = [r for m in messages if m is not None for r in m.rows]
        columns = list(zip(*found)) or [(), (), (), ()]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64()]
        table = pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["file", "block", "part", "bytes"])
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{_MANIFEST}", compression=None) as out:
            pq.write_table(table, out)

    def abort(self, messages: list[Parts | None]) -> None:
        drop_folder(self.staging)


class PieceSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> PieceWriter:
        return PieceWriter(self.options)


def drop_folder(path: str) -> None:
    """Delete a folder with all it holds; absent folders are fine."""
    store, base = open_store(path)
    if store.get_file_info(base).type.name == "Directory":
        store.delete_dir(base)


def _join_parts(root: str, staging: str):
    """Put each file's parts into place; repeating it after a lost task is harmless."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_store(root)
        held = open_store(staging)[1]
        file, parts = None, []

        def place() -> None:
            target = f"{base}/{file}"
            store.create_dir(target.rpartition("/")[0], recursive=True)
            staged = f"{held}/{parts[0][0]}" if len(parts) == 1 else f"{held}/joined-{uuid.uuid4().hex}"
            if len(parts) != 1:
                with store.open_output_stream(staged, compression=None) as out:
                    for name, _ in parts:
                        with store.open_input_stream(f"{held}/{name}", compression=None) as part:
                            while piece := part.read(_COPY_BYTES):
                                out.write(piece)
            here, there = store.get_file_info([staged, target])
            if here.type.name == "NotFound" and there.type.name == "File" and there.size == sum(n for _, n in parts):
                return  # an earlier attempt of this task moved it
            store.move(staged, target)

        for frame in frames:
            for name, part, size in zip(frame["file"], frame["part"], frame["bytes"]):
                if name != file:
                    if file is not None:
                        place()
                    file, parts = name, []
                if part is not None:
                    parts.append((part, int(size)))
            yield pd.DataFrame({"file": frame["file"]})
        if file is not None:
            place()

    return run


def write_pieces(pieces: DataFrame, root: str, files: DataFrame) -> None:
    """Write ``pieces(file, block, data BINARY)`` to ``root/<file>``, in order of block and of rows inside a block.

    The rows of a block must lie in one partition, one after the other.  Every
    file of ``files(file)`` is written, without pieces as an empty one.
    """
    spark = pieces.sparkSession
    spark.dataSource.register(PieceSink)
    staging = f"{root.rstrip('/')}/_staging-{uuid.uuid4().hex}"
    try:
        pieces.select("file", F.col("block").cast("bigint").alias("block"), "data").write.format(FORMAT).mode("append").save(staging)
        parts = spark.read.schema("file string, block bigint, part string, bytes bigint").parquet(f"{staging}/{_MANIFEST}")
        (
            files.select("file").distinct().join(parts, "file", "left").repartition("file").sortWithinPartitions("file", "block")
            .mapInPandas(_join_parts(root, staging), "file string").write.format("noop").mode("overwrite").save()
        )
    finally:
        drop_folder(staging)
