"""Exact medians by counting: no task ever holds the values of a key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slidelake.operators.skew import salted_join
from slidelake.session import cut_lineage

# Stretches that a key's range is counted in per round.
_DIGITS = 256


@F.pandas_udf(T.LongType())
def _ordered_bits(values: pd.Series) -> pd.Series:
    """Whole numbers in the order of the doubles; NaN is the largest, both zeros are one."""
    v = values.to_numpy(np.float64) + 0.0
    bits = np.where(np.isnan(v), np.nan, v).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


@F.pandas_udf(T.DoubleType())
def _from_bits(keys: pd.Series) -> pd.Series:
    k = keys.to_numpy(np.int64)
    return pd.Series(np.where(k < 0, k ^ np.int64(0x7FFFFFFFFFFFFFFF), k).view(np.float64))


def exact_medians(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Median of ``value`` per key, as ``F.median`` gives it.

    Nulls do not count, infinite values do, NaN is the largest; an even number of values
    gives the mean of the middle two and keys without values give null.  Values
    become whole numbers of the same order, written once.  A round counts them by stretches of the
    range still open and keeps the stretch that holds the wanted rank, with the
    least and greatest value found in it: at most nine rounds for 64 bits.
    Counts combine before the shuffle, whatever the size of a key.
    """
    v = F.col(value).cast("double")
    known = df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull())
    rows = cut_lineage(known.select(*keys, _ordered_bits("_v").alias("_v")))
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    middle = F.array_distinct(F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)))
    ranks = cut_lineage(
        totals.withColumn("_at", F.explode(middle)).select(*keys, "_at", F.col("_at").alias("_rank"), "_lo", "_hi")
    )
    settled = F.col("_lo") == F.col("_hi")
    middles = ranks.filter(settled)
    while True:
        ranks = ranks.filter(~settled)
        if ranks.isEmpty():
            break
        ranks = cut_lineage(_narrowed(rows, ranks, keys))
        middles = middles.unionAll(ranks.filter(settled))
    # Arrow hands a NaN back as null.
    medians = middles.withColumn("_found", F.coalesce(_from_bits("_lo"), F.lit(float("nan")))).groupBy(*keys).agg(
        F.min("_found").alias("_low"), F.max("_found").alias("_high")
    )
    low, high, half = F.col("_low"), F.col("_high"), F.lit(0.5)
    both = F.when(low == high, low).otherwise(low * half + high * half)
    empty = df.groupBy(*keys).agg(F.count(v).alias("_n")).filter("_n = 0").select(*keys, F.lit(None).cast("double").alias(name))
    return medians.select(*keys, both.alias(name)).unionAll(empty)


def _stretch() -> Column:
    """Number of a value's stretch, growing with the value; both ends have one of their own.

    Halves, since the whole range may be beyond the largest whole number.
    """
    half = lambda c: F.shiftright(F.col(c), 1)
    part = F.try_divide((half("_v") - half("_lo")).cast("double"), (half("_hi") - half("_lo")).cast("double"))
    inner = F.coalesce(F.floor(part * _DIGITS), F.lit(0))
    return F.when(F.col("_v") == F.col("_hi"), F.lit(_DIGITS + 1)).when(F.col("_v") == F.col("_lo"), F.lit(-1)).otherwise(inner)


def _narrowed(rows: DataFrame, ranks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ranks with the range of the stretch that holds them."""
    named = [f"_k{i}" for i in range(len(keys))]
    # Keys may be null, so they meet through a name that is not.
    tagged = lambda frame: frame.withColumn("_key", F.to_json(F.struct(*keys)))
    wanted = tagged(ranks).select("_key", *[F.col(k).alias(n) for k, n in zip(keys, named)], "_at", "_rank", "_lo", "_hi")
    inside = salted_join(tagged(rows).select("_key", "_v"), wanted, ["_key"]).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    counts = inside.withColumn("_stretch", _stretch()).groupBy("_key", *named, "_at", "_rank", "_stretch").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    order = Window.partitionBy("_key", "_at").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(order), F.lit(0))
    return counts.withColumn("_before", before).filter(
        (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n"))
    ).select(
        *[F.col(n).alias(k) for n, k in zip(named, keys)], "_at", (F.col("_rank") - F.col("_before")).alias("_rank"),
        "_lo", "_hi",
    )
