"""Batch progress, timings and recent lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidelake import schema as S
from slidelake.operators.ordering import running_sums
from slidelake.operators.pyramid import pyramid_name
from slidelake.operators.selection import exact_medians
from slidelake.session import cut_lineage

# Fixed shares of the progress bar: start and length of each stage.
STAGE_PROGRESS = {
    "thumbnail": (0.01, 0.0),
    "load": (0.02, 0.0),
    "resize": (0.03, 0.0),
    "dzsave": (0.04, 0.0),
    "dzsave_progress": (0.04, 0.94),
    "packing": (0.98, 0.02),
}
OTHER_STAGE = 0.5


def stage_progress(events: DataFrame) -> DataFrame:
    """Overall progress fraction of a ``(stage, current, total)`` event."""
    share = F.col("current") / F.greatest(F.col("total"), F.lit(1))
    progress: Column = F.lit(OTHER_STAGE)
    for stage, (start, length) in STAGE_PROGRESS.items():
        value = F.lit(start) + F.lit(length) * share if length else F.lit(start)
        progress = F.when(F.col("stage") == stage, value).otherwise(progress)
    return events.withColumn("progress", progress)


def batch_state(events: DataFrame) -> DataFrame:
    """Latest status, progress and error per file of a status log."""
    latest = F.struct("status", "progress", "error")
    return events.groupBy("file").agg(F.max_by(latest, "seq").alias("s")).select("file", "s.*")


def batch_overview(events: DataFrame, native: bool = False) -> DataFrame:
    """Completed share of all files and the pyramid of the first file that got done."""
    per_file = events.groupBy("file").agg(
        F.max_by("status", "seq").alias("status"),
        F.min(F.when(F.col("status") == "done", F.col("seq"))).alias("done_seq"),
    )
    finished = F.count_if(F.col("status").isin("done", "skipped", "error"))
    return per_file.agg(
        F.count(F.lit(1)).alias("files"),
        finished.alias("completed"),
        (finished / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("overall"),
        F.min_by("file", "done_seq").alias("first_file"),
    ).withColumn("first_result", pyramid_name(F.col("first_file"), native))


def bench_summary(timings: DataFrame) -> DataFrame:
    """Median time per configuration, the fastest flagged."""
    medians = cut_lineage(exact_medians(timings, ["config"], "seconds", "median_seconds"))
    best = medians.agg(F.min_by("config", F.struct("median_seconds", "config")))
    return medians.withColumn("is_best", F.col("config") == best.scalar())


def running_timing(log: DataFrame, columns: list[str], every: int = 100, bucket_rows: int = 1 << 16) -> DataFrame:
    """Running averages of timings, reported every ``every`` requests.

    ``seq`` numbers the requests of a source from 1 without gaps, so a bucket
    holds at most ``bucket_rows`` rows.
    """
    summed = running_sums(
        log, ["source"], F.floor(F.col("seq") / bucket_rows), ["seq"], {f"_sum_{c}": c for c in columns}
    )
    return summed.filter(F.col("seq") % every == 0).select(
        "source", "seq", *[(F.col(f"_sum_{c}") / F.col("seq")).alias(f"avg_{c}") for c in columns]
    )


def recent(opens: DataFrame, n: int = S.MAX_RECENT) -> DataFrame:
    """Most recently opened distinct paths per user, newest first."""
    newest = (
        opens.filter(F.coalesce(F.col("path"), F.lit("")) != "")
        .groupBy("user_id", "path").agg(F.max(F.struct("ts", "seq")).alias("last"))
    )
    by_time = Window.partitionBy("user_id").orderBy(F.col("last").desc())
    return (
        newest.withColumn("position", F.row_number().over(by_time))
        .filter(F.col("position") <= n)
        .select("user_id", "path", "position", F.col("last.ts").alias("ts"))
    )
