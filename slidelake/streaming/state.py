"""Edit, status and ingest streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from slidelake.functions import slide_id
from slidelake.operators.annotations import fold_log, merge_folds, resolve_state
from slidelake.operators.pyramid import plan_batch, pyramid_name
from slidelake.session import cut_lineage
from slidelake.sources.slides import slide_files
from slidelake.streaming.folded import FoldedTable, to_folded

def annotation_table(changes: DataFrame, path: str, **compaction) -> FoldedTable:
    """The state table that :func:`follow_annotations` keeps for an edit stream of this shape."""
    return FoldedTable(changes.sparkSession, path, fold_log(changes).schema, merge_folds, **compaction)


def follow_annotations(changes: DataFrame, table: FoldedTable, checkpoint: str) -> StreamingQuery:
    """Fold an edit stream to one state row per annotation, group and slide.

    The fold is the one the batch operator uses; :func:`live_annotations` turns
    the rows of ``table.read()`` into annotations.  The stream itself holds no state.
    """
    return to_folded(changes, table, fold_log, checkpoint)


def live_annotations(state: DataFrame) -> DataFrame:
    """Current annotations from the newest state rows."""
    return resolve_state(state)


def live_group_counts(state: DataFrame) -> DataFrame:
    """Current number of annotations per slide and group."""
    return resolve_state(state).groupBy("slide_id", "group").agg(F.count(F.lit(1)).alias("n"))


def newest_status(events: DataFrame) -> DataFrame:
    """Newest ``(seq, status, progress, error)`` per file; also merges its own results."""
    latest = F.max(F.struct("seq", "status", "progress", "error"))
    return events.groupBy("file").agg(latest.alias("s")).select("file", "s.*")


def status_table(events: DataFrame, path: str, **compaction) -> FoldedTable:
    """The table that :func:`follow_status` keeps for a status stream of this shape."""
    return FoldedTable(events.sparkSession, path, newest_status(events).schema, newest_status, **compaction)


def follow_status(events: DataFrame, table: FoldedTable, checkpoint: str) -> StreamingQuery:
    """Latest status per file of a status stream, whatever order its rows come in."""
    return to_folded(events, table, newest_status, checkpoint)


def status_counts(state: DataFrame) -> DataFrame:
    """Files per status from the rows that :func:`follow_status` keeps."""
    return state.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def listing_stream(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Slide files arriving in a folder; contents are not read."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length bigint, content binary")
        .option("maxFilesPerTrigger", per_trigger).load(path)
        .select("path", "modificationTime", "length")
    )
    return slide_files(files)


def ingest_stream(
    arrivals: DataFrame, catalog: str, checkpoint: str, build: Callable[[DataFrame], DataFrame] | None = None,
    native: bool = False, force: bool = False,
) -> StreamingQuery:
    """Plan and build arriving slides once; results go to a catalog folder by micro-batch.

    ``build`` maps the planned slides to rows that at least keep ``slide_id``;
    without it the plan itself is recorded.  Slides that an earlier batch built
    are skipped, whatever their file's name or time says now; a replayed batch
    ignores its own earlier output and writes it anew.
    """

    def ingest(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        named = batch.withColumn("pyramid", pyramid_name(F.col("path"), native)).withColumn(
            "slide_id", slide_id(F.col("pyramid"))
        )
        # Files of one stem share a pyramid; the first path stands for them.
        found = named.groupBy("slide_id", "pyramid").agg(F.min("path").alias("path"))
        status = _built(spark, catalog, batch_id)
        # Written once: a build reads its plan many times, and the batch's files would be listed for each.
        # The number of files is stated, since a build's work is not in the bytes of its plan.
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        plan = plan_batch(found, status, force, native).filter(F.col("action") == "build")
        plan = cut_lineage(plan.repartition(width, "slide_id"))
        result = plan if build is None else build(plan)
        result.write.mode("overwrite").parquet(f"{catalog}/batch_id={batch_id}")

    return (
        arrivals.writeStream.foreachBatch(ingest)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def _built(spark: SparkSession, catalog: str, before: int) -> DataFrame:
    """Slides built by earlier micro-batches, in the shape of a status table."""
    empty = "slide_id bigint, status string, native_mpp_mode boolean"
    if before == 0:
        return spark.createDataFrame([], empty)
    rows = spark.read.option("basePath", catalog).parquet(catalog).filter(F.col("batch_id") < before)
    return rows.select(
        "slide_id", F.lit("complete").alias("status"), F.lit(None).cast("boolean").alias("native_mpp_mode")
    ).distinct()


