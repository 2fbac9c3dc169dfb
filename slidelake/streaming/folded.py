"""Tables that a stream keeps as mergeable rows: one snapshot and the batches after it.

A micro-batch is folded by itself and written to a folder of its number, so the
stream needs no state; readers merge the newest snapshot with the batches after
it.  Batches are merged into a new snapshot once they are many or large enough.
``merge`` must give the same result in any order and for rows met twice: rows
carry their own order (a sequence number).  A late row then takes its
place, and a replayed batch changes nothing, before and after compaction.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from slidelake.sources.files import open_store
from slidelake.sources.pieces import drop_folder

_DONE = "_done"  # Spark's readers leave out names that begin so


@dataclass(frozen=True)
class FoldedTable:
    """A folder of folded rows; one stream writes it, any number of jobs read it.

    Compaction starts when ``every`` batches are newer than the snapshot and hold
    at least ``share`` of its bytes, or when there are ``most`` of them: so a row is
    written again about ``1 / share`` times while the table doubles, and a reader
    opens at most ``most`` folders besides the snapshot.
    """

    spark: SparkSession
    path: str
    schema: StructType
    merge: Callable[[DataFrame], DataFrame]
    every: int = 8
    share: float = 0.25
    most: int = 64

    def read(self) -> DataFrame:
        """The merged rows; only the newest snapshot and the batches after it are opened."""
        folders = self.folders()
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.merge(self.spark.read.schema(self.schema).parquet(*folders))

    def folders(self) -> list[str]:
        """Folders that make up the table now."""
        upto = self._upto()
        newer = [n for n in self._numbers("batches") if upto is None or n > upto]
        return ([] if upto is None else [self._folder("snapshots", upto)]) + [self._folder("batches", n) for n in newer]

    def save(self, rows: DataFrame, number: int) -> None:
        """Write a batch, whole or not at all; one that a snapshot holds already is left out."""
        upto = self._upto()
        if upto is None or number > upto:
            self._write(rows, "batches", number)

    def compact_if_due(self) -> bool:
        upto = self._upto()
        newer = [n for n in self._numbers("batches") if upto is None or n > upto]
        if len(newer) < self.every:
            return False
        held = 0 if upto is None else self._bytes("snapshots", upto)
        if len(newer) < self.most and sum(self._bytes("batches", n) for n in newer) < self.share * held:
            return False
        self.compact()
        return True

    def compact(self) -> None:
        """Merge everything into a new snapshot.

        What the snapshot before this one replaced is deleted; the snapshot
        before and its newer batches stay for readers that listed them already.
        """
        before = self._upto()
        numbers = [n for n in self._numbers("batches") if before is None or n > before]
        if not numbers:
            return
        self._write(self.read(), "snapshots", numbers[-1])
        if before is not None:
            for n in self._numbers("batches", finished=False):
                if n <= before:
                    drop_folder(self._folder("batches", n))
            for n in self._numbers("snapshots", finished=False):
                if n < before:
                    drop_folder(self._folder("snapshots", n))

    def _upto(self) -> int | None:
        """Last batch held by the newest finished snapshot."""
        return max(self._numbers("snapshots"), default=None)

    def _folder(self, kind: str, number: int) -> str:
        return f"{self.path.rstrip('/')}/{kind}/{number}"

    def _numbers(self, kind: str, finished: bool = True) -> list[int]:
        store, base = open_store(f"{self.path.rstrip('/')}/{kind}")
        listed = store.get_file_info(pafs.FileSelector(base, allow_not_found=True))
        numbers = sorted(int(f.base_name) for f in listed if f.type == pafs.FileType.Directory and f.base_name.isdigit())
        if not finished or not numbers:
            return numbers
        marks = store.get_file_info([f"{base}/{n}/{_DONE}" for n in numbers])
        return [n for n, m in zip(numbers, marks) if m.type == pafs.FileType.File]

    def _bytes(self, kind: str, number: int) -> int:
        store, base = open_store(self._folder(kind, number))
        with store.open_input_stream(f"{base}/{_DONE}") as mark:
            return int(mark.read())

    def _write(self, rows: DataFrame, kind: str, number: int) -> None:
        folder = self._folder(kind, number)
        rows.write.mode("overwrite").parquet(folder)
        store, base = open_store(folder)
        size = sum(f.size for f in store.get_file_info(pafs.FileSelector(base)) if f.type == pafs.FileType.File)
        with store.open_output_stream(f"{base}/{_DONE}") as mark:
            mark.write(str(size).encode())


def to_folded(
    stream: DataFrame, table: FoldedTable, fold: Callable[[DataFrame], DataFrame], checkpoint: str
) -> StreamingQuery:
    """Fold each micro-batch of a stream into a table."""

    def save(batch: DataFrame, number: int) -> None:
        table.save(fold(batch), number)
        table.compact_if_due()

    return (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
