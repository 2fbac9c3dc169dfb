"""Ordered computations that stay distributed when one key holds most rows.

A plain window puts all rows of one key into one task.  The helpers here split
a key's timeline into buckets whose size the caller can bound, run the window
inside a bucket, and carry one summary row per bucket across the borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidelake.operators.skew import shuffled
from slidelake.session import cut_lineage


def explode_range(df: DataFrame, start: Column, end: Column, name: str) -> DataFrame:
    """One row per integer in the half-open range; empty ranges give no row.

    Spark takes the result for no larger than ``df``, so it is marked as one to shuffle.
    """
    bounded = df.withColumn("_lo", start.cast("int")).withColumn("_hi", end.cast("int"))
    return shuffled(
        bounded.filter(F.col("_hi") > F.col("_lo"))
        .withColumn(name, F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)))
        .drop("_lo", "_hi")
    )


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    cols: Sequence[str],
    name: str = "prev",
    beside: DataFrame | None = None,
) -> DataFrame:
    """Add a struct with the given columns of the preceding row of the same key.

    ``bucket`` must grow with the order; rows of one bucket share a task.  The columns of ``beside``, a table by key,
    are laid beside the rows as by a left join; they travel with the buckets' summaries, so the rows stay where they are.
    """
    marked = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    tails = marked.groupBy(*keys, "_bucket").agg(
        F.max_by(F.struct(*cols), F.struct(*order)).alias("_tail")
    )
    tails = tails.withColumn(
        "_tail", F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_bucket"))
    )
    if beside is not None:
        tails = tails.join(shuffled(beside), list(keys), "left")
    local = marked.withColumn(name, F.lag(F.struct(*cols)).over(inside))
    return (
        local.join(shuffled(tails), [*keys, "_bucket"])
        .withColumn(name, F.coalesce(F.col(name), F.col("_tail")))
        .drop("_bucket", "_tail")
    )


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    sums: dict[str, str],
    inclusive: bool = True,
) -> DataFrame:
    """Add running sums ``{new column: summed column}`` per key, bucket by bucket."""
    marked = df.withColumn("_bucket", bucket)
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    frame = inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    totals = marked.groupBy(*keys, "_bucket").agg(
        *[F.sum(source).alias(f"_t_{new}") for new, source in sums.items()]
    )
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_b_{new}") for new in sums],
    )
    local = marked.select(
        "*", *[F.coalesce(F.sum(source).over(frame), F.lit(0)).alias(new) for new, source in sums.items()]
    )
    joined = local.join(shuffled(totals), [*keys, "_bucket"])
    for new in sums:
        joined = joined.withColumn(new, F.col(new) + F.col(f"_b_{new}"))
    return joined.drop("_bucket", *[f"_b_{new}" for new in sums])


def number_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "row_num"
) -> DataFrame:
    """Number the rows of each key from 1 without putting a key into one task.

    Rows are range-partitioned by key and order, so a big key spans many
    partitions; the checkpoint fixes that placement before the per-partition
    counts are turned into offsets.  ``order`` must be unique within a key.
    """
    ranged = (
        df.repartitionByRange(*[F.col(c) for c in (*keys, *order)])
        .sortWithinPartitions(*keys, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    placed = cut_lineage(ranged)
    counts = placed.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first")
    )
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_part").alias("_p"),
        "_first",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
    )
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return (
        placed.join(shuffled(offsets), same)
        .withColumn(name, (F.col("_pos") - F.col("_first") + F.col("_offset") + 1).cast("bigint"))
        .drop("_part", "_pos", "_p", "_first", "_offset", *[f"_k_{k}" for k in keys])
    )
