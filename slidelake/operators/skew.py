"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASHABLE = (T.NumericType, T.StringType, T.BooleanType, T.TimestampType, T.TimestampNTZType)


def shuffled(df: DataFrame) -> DataFrame:
    """A table that joins meet by shuffles only, never as a copy in the driver and every executor.

    Spark judges a table by the bytes of its compressed files and does not count what an
    explode adds, so tables of millions of slides, levels or tiles pass as small ones.
    The mark holds through selections, filters, explodes and groupings up to the next join.
    """
    return df.hint("merge")


def default_salts(df: DataFrame) -> int:
    """1 where adaptive execution splits skewed joins, else in proportion to the cluster's shuffle width, 8 at most."""
    conf = df.sparkSession.conf
    adaptive = all(conf.get(f"spark.sql.adaptive.{name}").lower() == "true" for name in ("enabled", "skewJoin.enabled"))
    if adaptive and not df.isStreaming:
        return 1
    return max(1, min(8, int(conf.get("spark.sql.shuffle.partitions")) // 8))


def salted_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", salts: int | None = None,
    measured: bool = False,
) -> DataFrame:
    """Join a big table with a per-key table (slides, levels, viewers) that grows with the data too.

    Rows of one key spread over tasks.  Adaptive execution splits the shuffle of
    a busy key, so the right side is not repeated; the salt is 0 then, and only
    keeps a grouping of the right side from standing in for that shuffle.
    Elsewhere the left side gets a salt computed from its own values, so a
    retried task routes every row as before, and the right side is repeated
    once per salt.  ``measured`` says that the right side is a written table or
    a selection of one, whose size Spark knows; a small one is then copied.
    """
    mark = (lambda df: df) if measured else shuffled
    salts = salts or default_salts(left)
    spread = [
        f.name for f in left.schema.fields if f.name not in keys and isinstance(f.dataType, HASHABLE)
    ]
    if salts == 1 or not spread:
        zero = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int")
        return left.withColumn("_salt", zero).join(
            mark(right.withColumn("_salt", zero)), [*keys, "_salt"], how
        ).drop("_salt")
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(mark(copies), [*keys, "_salt"], how).drop("_salt")
