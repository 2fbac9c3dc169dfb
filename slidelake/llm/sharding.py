"""Sharding by proportional stratified interleaving.

The rows of a source are shuffled by a seeded hash and ranked; rank over size is
a row's place between 0 and 1 within its source.  Sorting all rows by that
place interleaves the sources in proportion, so that any stretch of the order
holds the mixture, and cutting the order into equal stretches gives shards
whose row counts differ by one at most.  Both rankings number range-partitioned
rows, so neither a source nor a shard needs one task.

The order follows from the rows' values and the seed alone.  A null source is a
source of its own, a null text counts as empty, repeated rows are rows like any
others, and other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.operators.ordering import number_rows
from slidelake.session import cut_lineage

SHARDS = 8
SEED = "interleave"
LAW = "rows"


def _facts(docs: DataFrame, seed: str, *keys: str) -> DataFrame:
    """What sharding needs of each row; texts stay behind."""
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    facts = docs.select(
        *keys, F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
    )
    drawn = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text_crc32").cast("string"), F.col("size").cast("string")))
    return facts.withColumn("_draw", drawn)


def _interleave(facts: DataFrame, shards: int) -> DataFrame:
    ties = ["doc_id", "text_crc32", "size"]
    ranked = number_rows(facts, ["source"], ["_draw", *ties], "_rank")
    # One row per source, a few numbers each; Spark decides whether it is small enough to send around.
    sizes = ranked.groupBy("source").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("source", "_source")
    placed = ranked.join(sizes, F.col("source").eqNullSafe(F.col("_source"))).withColumn(
        "_place", (2 * F.col("_rank") - 1) / (2 * F.col("_n"))
    ).drop("_source", "_n", "_rank")
    ordered = number_rows(placed, [], ["_place", "_draw", "source", *ties], "_at")
    total = max(1, ordered.count())
    # Shard k holds the places from ceil(k * total / shards) on.
    return (
        ordered.withColumn("_at", F.col("_at") - 1)
        .withColumn("shard", F.expr(f"_at * {shards} div {total}").cast("int"))
        .withColumn("slot", F.col("_at") - F.expr(f"(shard * {total}L + {shards - 1}) div {shards}"))
        .drop("_at", "_place", "_draw")
    )


def assign_shards(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """``(doc_id, source, size, text_crc32, law, shard, slot)``, one row per row of the documents.

    ``size`` is the text's bytes in UTF-8 plus one, ``slot`` counts the rows of a
    shard from 0 without gaps.  Row counts of shards differ by one at most.
    """
    return _interleave(_facts(docs, seed), shards).withColumn("law", F.lit(LAW))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """Write all columns of the documents below ``path/shard=k``, in slot order, and return the assignment.

    Files of a shard are ordered by name; the texts are shuffled once, to their
    shards.  Columns named ``shard`` or ``slot`` are written as ``doc_shard`` and ``doc_slot``.
    """
    docs = docs.withColumnsRenamed({"shard": "doc_shard", "slot": "doc_slot"})
    keyed = cut_lineage(docs.withColumn("__row__", F.monotonically_increasing_id()))
    assigned = cut_lineage(_interleave(_facts(keyed, seed, "__row__"), shards).withColumn("law", F.lit(LAW)))
    (
        keyed.join(assigned.select("__row__", "shard", "slot"), "__row__").drop("__row__")
        .repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").parquet(path)
    )
    return assigned.drop("__row__")
