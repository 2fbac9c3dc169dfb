"""Sinks that survive replays, and bounded runs."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from slidelake.session import scratch_path


def to_table(result: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished rows to a parquet folder with Spark's exactly-once file sink."""
    return (
        result.writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def run_bounded(query: StreamingQuery, timeout: float = 600) -> None:
    """Wait for an available-now query, however much there is to do; one that gets no further for ``timeout`` seconds is an error."""
    tracker = query._jsq.sparkSession().sparkContext().statusTracker()

    def progress() -> tuple:
        stages = [tracker.getStageInfo(i) for i in tracker.getActiveStageIds()]
        tasks = sorted((s.get().stageId(), s.get().numCompletedTasks()) for s in stages if s.isDefined())
        last = query.lastProgress
        return last and last["batchId"], tasks

    try:
        seen, since = None, time.monotonic()
        while not query.awaitTermination(min(timeout, 5)):
            now = progress()
            if now != seen:
                seen, since = now, time.monotonic()
            elif time.monotonic() - since >= timeout:
                raise TimeoutError(f"stream got no further for {timeout} s: {query.status['message']}")
    finally:
        query.stop()


def append_result(spark: SparkSession, result: DataFrame) -> DataFrame:
    """Run an append-mode stream over what is available and read its output back."""
    path = scratch_path(spark, "stream")
    run_bounded(to_table(result, path + "/out", path + "/checkpoint"))
    return spark.read.schema(result.schema).parquet(path + "/out")
