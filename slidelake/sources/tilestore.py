"""Tile tables bucketed by tile key, and joins that leave the pixels where they lie.

A store is a table of ``slide_id, level, col, row`` and payload columns, hashed
into buckets by the whole key.  A slide or level of any size spreads over all
buckets.  Whatever is joined with it by tile key is narrow and moves to the
buckets; conditions on slides or levels are first turned into tile keys, read
from the key columns alone.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from slidelake.operators.skew import salted_join
from slidelake.session import scratch_path

TILE = ["slide_id", "level", "col", "row"]


def write_tile_store(
    tiles: DataFrame, path: str | None = None, buckets: int | None = None, keys: Sequence[str] = TILE
) -> DataFrame:
    """Write tiles bucketed by their ``keys`` and return the stored table.

    The files lie below ``path``, by default in the shared folder.  A bucket is
    one task of every later join; its size is the store's divided by ``buckets``
    (default: the shuffle width), so raise that with the pixels.
    """
    spark = tiles.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"tiles_{uuid.uuid4().hex[:16]}"
    (
        tiles.repartition(n, *keys).write.format("parquet").option("path", path or scratch_path(spark, "tiles"))
        .bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    )
    return spark.table(name)


def wanted_tiles(tiles: DataFrame, wanted: DataFrame, keys: Sequence[str] = TILE) -> DataFrame:
    """The tiles whose ``keys`` are wanted; pixels of a store do not move.

    Keys that are not whole tile keys (slides, levels) are matched with the
    store's key columns first.
    """
    narrow = wanted.select(*keys).distinct()
    if list(keys) != TILE:
        narrow = tiles.select(*TILE).join(narrow, list(keys), "left_semi")
    return tiles.join(narrow, TILE, "left_semi")


def with_slide_columns(tiles: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tiles with the columns of a per-slide or per-level table, for the tiles it knows.

    The columns are laid beside the tile keys, and those meet the pixels in their buckets.
    """
    told = salted_join(tiles.select(*TILE), small, keys)
    return tiles.join(told, TILE)


def payload_moves(df: DataFrame, payload: str = "rgb") -> list[str]:
    """The shuffles of a plan, as it stands before it runs, that carry the payload column."""
    found: list[str] = []

    def visit(node) -> None:
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            visit(node.initialPlan())
            return
        if name == "Exchange" and any(a.name() == payload for a in _items(node.output())):
            found.append(node.simpleString(100))
        for child in _items(node.children()):
            visit(child)

    visit(df._jdf.queryExecution().executedPlan())
    return found


def _items(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.size())]
