"""Streaming over sorted groups in Python workers."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def map_sorted_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    make: Callable[[tuple, Iterable], Iterable[tuple]],
    schema: str,
    names: Sequence[str],
    flush_bytes: int = 32 << 20,
) -> DataFrame:
    """Turn each group of rows into output rows while reading the partition once.

    ``make(key, rows)`` gets an iterator over the group's rows in order, so a
    group is never held as a whole.  Unlike a grouped pandas function this has
    no per-group set-up, and the number of partitions is stated: pixel work is
    bound by the processor, not by the shuffle's size in bytes.
    """
    columns = [*keys, *[c for c in df.columns if c not in keys]]
    depth = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for pdf in batches for row in pdf.itertuples(index=False))
        out: list[tuple] = []
        held = 0
        for key, group in itertools.groupby(rows, key=lambda row: tuple(row[:depth])):
            for made in make(key, group):
                out.append(made)
                held += sum(len(v) for v in made if isinstance(v, bytes)) + 64
            if held > flush_bytes:
                yield pd.DataFrame(out, columns=list(names))
                out, held = [], 0
        if out:
            yield pd.DataFrame(out, columns=list(names))

    return (
        df.select(*columns)
        .repartition(partitions_of(df), *keys)
        .sortWithinPartitions(*keys, *order)
        .mapInPandas(run, schema)
    )
