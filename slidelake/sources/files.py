"""Small files written and listed by path, on any file system."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def open_store(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI; ``file:`` is one scheme among others."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def write_files(files: DataFrame, root: str) -> None:
    """Write ``(path, content BINARY)`` below a root; a repeated task writes the same bytes again."""

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_store(root.rstrip("/"))
        for pdf in batches:
            for f in pdf.itertuples(index=False):
                path = f"{base}/{f.path}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                with store.open_output_stream(path, compression=None) as out:
                    out.write(f.content)
            yield pdf[["path"]]

    files.select("path", "content").mapInPandas(save, "path string").write.format("noop").mode("overwrite").save()


# What a job that still runs has not put into place yet.
_STAGING = "_staging-"
_ROWS = 1 << 13


def subfolders(spark: SparkSession, root: str) -> DataFrame:
    """``(folder)``: names of the folders right below a root, in as many partitions as shuffles have; none for an absent root.

    One task lists the names and passes them on; nothing goes through the driver.
    A local folder is read name by name, other file systems answer with a whole listing.
    """

    def names(store: pafs.FileSystem, base: str) -> Iterator[str]:
        if store.get_file_info(base).type != pafs.FileType.Directory:
            return
        if isinstance(store, pafs.LocalFileSystem):
            with os.scandir(base) as entries:
                yield from (e.name for e in entries if e.is_dir())
        else:
            yield from (f.base_name for f in store.get_file_info(pafs.FileSelector(base)) if f.type == pafs.FileType.Directory)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held = []
            for name in names(*open_store(root)) if len(frame) else ():
                held.append(name)
                if len(held) >= _ROWS:
                    yield pd.DataFrame({"folder": held})
                    held = []
            yield pd.DataFrame({"folder": held}, dtype="object")

    # The number is given, since adaptive execution would bring so few bytes to one task.
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return spark.range(0, 1, 1, 1).mapInPandas(run, "folder string").repartition(width, "folder")


def pyramid_listing(spark: SparkSession, root: str) -> DataFrame:
    """``(slide_id, rel_path)`` of everything below the pyramid folders of a root, as ``pyramid_status`` reads it.

    Files of any name and size count, and folders too; tasks list one pyramid after the other.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_store(root.rstrip("/"))
        for frame in frames:
            ids, paths = [], []
            for name in frame["folder"]:
                below = f"{base}/{name}"
                found = store.get_file_info(pafs.FileSelector(below, allow_not_found=True, recursive=True))
                paths += ["", *(f.path[len(below) + 1:] for f in found)]
                ids += [name] * (1 + len(found))
                if len(ids) >= _ROWS:
                    yield pd.DataFrame({"slide_id": ids, "rel_path": paths})
                    ids, paths = [], []
            yield pd.DataFrame({"slide_id": ids, "rel_path": paths}, dtype="object")

    pyramids = subfolders(spark, root).filter(~F.col("folder").startswith(_STAGING))
    return pyramids.mapInPandas(run, "slide_id string, rel_path string")


def pyramid_documents(listing: DataFrame, root: str) -> DataFrame:
    """``(slide_id, document)``: the metadata file of each listed pyramid that has one, read by tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = open_store(root.rstrip("/"))
        for frame in frames:
            texts = [read_text(store, f"{base}/{name}/metadata.json") for name in frame["slide_id"]]
            yield pd.DataFrame({"slide_id": frame["slide_id"], "document": texts})

    return listing.filter("rel_path = 'metadata.json'").select("slide_id").mapInPandas(run, "slide_id string, document string")


def read_text(store: pafs.FileSystem, path: str) -> str:
    """A whole small file as text; bytes that are no UTF-8 are replaced, as Spark's reader does."""
    with store.open_input_stream(path, compression=None) as file:
        return file.read().decode("utf-8", "replace")
