"""Catalogue: batch status and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.operators import status as B
from slidelake.operators.pyramid import pyramid_status
from slidelake.operators.skew import shuffled
from slidelake.plans.bridge import DERIVED, Bridge, oracle
from slidelake.plans.pipelines import build_job
from slidelake.plans.registry import query
from slidelake.session import cut_lineage, scratch_path
from slidelake.sources.files import pyramid_documents, pyramid_listing
from slidelake.streaming import sinks, state
from slidelake.streaming import viewports as SV

@query("b01_stage_progress", """
    SELECT event_id, round(CASE stage WHEN 'thumbnail' THEN 0.01 WHEN 'load' THEN 0.02 WHEN 'resize' THEN 0.03 WHEN 'dzsave' THEN 0.04
        WHEN 'dzsave_progress' THEN 0.04 + 0.94 * (current / greatest(total, 1)) WHEN 'packing' THEN 0.98 + 0.02 * (current / greatest(total, 1)) ELSE 0.5 END, 6)::DOUBLE AS progress
    FROM (SELECT event_id, ['thumbnail', 'load', 'resize', 'dzsave', 'dzsave_progress', 'packing', 'other'][event_id % 7 + 1] AS stage,
                 CAST(event_id % 50 AS DOUBLE) AS current, event_id % 60 AS total FROM events)""")
def _(b: Bridge) -> DataFrame:
    events = b.table("events").selectExpr(
        "event_id",
        "element_at(array('thumbnail', 'load', 'resize', 'dzsave', 'dzsave_progress', 'packing', 'other'), CAST(event_id % 7 AS INT) + 1) AS stage",
        "CAST(event_id % 50 AS DOUBLE) AS current", "event_id % 60 AS total",
    )
    return B.stage_progress(events).select("event_id", F.round("progress", 6).alias("progress"))


# arg_max skips nulls, so the error is looked up by the last sequence number.
_LATEST = """
    SELECT file, status, round(progress, 6) AS progress, error FROM (
        SELECT *, row_number() OVER (PARTITION BY file ORDER BY seq DESC) AS place FROM b_status) WHERE place = 1"""


@query("b02_batch_state", oracle(_LATEST, "b_status"))
def _(b: Bridge) -> DataFrame:
    return B.batch_state(b.derived("b_status")).withColumn("progress", F.round("progress", 6))


@query("b02_batch_overview", oracle(f"""
    SELECT count(*) AS files, count(*) FILTER (WHERE status IN ('done', 'skipped', 'error')) AS completed,
           round(count(*) FILTER (WHERE status IN ('done', 'skipped', 'error')) / count(*), 6) AS overall,
           (SELECT arg_min(file, seq) FROM b_status WHERE status = 'done') AS first_file,
           (SELECT regexp_replace(arg_min(file, seq), '.*/(.*)[.]svs', '\\1.pyramid') FROM b_status WHERE status = 'done') AS first_result
    FROM ({_LATEST})""", "b_status"))
def _(b: Bridge) -> DataFrame:
    return B.batch_overview(b.derived("b_status")).withColumn("overall", F.round("overall", 6))


@query("b03_bench_summary", """
    SELECT config, median_seconds, config = first(config) OVER (ORDER BY median_seconds, config) AS is_best
    FROM (SELECT user_id AS config, median(value) AS median_seconds FROM events GROUP BY user_id)""")
def _(b: Bridge) -> DataFrame:
    return B.bench_summary(b.table("events").selectExpr("user_id AS config", "value AS seconds"))


@query("b04_running_timing", """
    SELECT source, seq, round(s / seq, 6) AS avg_decode FROM (
        SELECT event_id % 2 AS source, event_id // 2 + 1 AS seq, sum(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY event_id % 2 ORDER BY event_id) AS s FROM events)
    WHERE seq % 100 = 0""")
def _(b: Bridge) -> DataFrame:
    log = b.table("events").selectExpr(
        "event_id % 2 AS source", "CAST(floor(event_id / 2) AS BIGINT) + 1 AS seq", "CAST(round(value * 100) AS BIGINT) AS decode"
    )
    return B.running_timing(log, ["decode"], bucket_rows=128).withColumn("avg_decode", F.round("avg_decode", 6))


@query("b05_recent", """
    SELECT user_id, path, CAST(position AS INTEGER) AS position FROM (
        SELECT user_id, path, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, arg_max(seq, (ts, seq)) DESC) AS position
        FROM (SELECT user_id, ts, event_id AS seq, CASE WHEN event_id % 9 = 0 THEN '' ELSE concat('/s/', event_id % 40) END AS path FROM events)
        WHERE path <> '' GROUP BY user_id, path) WHERE position <= 10""")
def _(b: Bridge) -> DataFrame:
    opens = b.table("events").selectExpr(
        "user_id", "ts", "event_id AS seq", "CASE WHEN event_id % 9 = 0 THEN '' ELSE concat('/s/', event_id % 40) END AS path"
    )
    return B.recent(opens).drop("ts")


# --- streams --------------------------------------------------------------


def _stream(b: Bridge, name: str) -> DataFrame:
    """A derived table read as a stream of its source files.

    The path is a glob, since the streaming reader takes folders and globs but
    not a single file.
    """
    source, columns = DERIVED[name]
    schema = b.table(source).schema
    raw = b.spark.readStream.schema(schema).parquet(f"{b.sf_dir}/{source}.parque[t]")
    if "ts" in schema.names:
        raw = raw.withColumn("ts", F.col("ts").cast("timestamp"))
    return raw.selectExpr(*columns)


def _demand_sql(starts: str) -> str:
    """Windows that the watermark (newest update less 5 minutes) has passed."""
    return oracle(f"""
    SELECT epoch_us(start) AS window_us, slide_id, level, col, "row", count(*) AS views
    FROM (SELECT *, unnest({starts}) AS start FROM (
        SELECT *, time_bucket(INTERVAL 3 HOURS, ts, TIMESTAMP '1970-01-01') AS s3, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS s6 FROM b_visible))
    WHERE start + INTERVAL 6 HOURS <= (SELECT max(ts) FROM b_viewports WHERE scale > 0) - INTERVAL 5 MINUTES
    GROUP BY ALL""", "b_visible", "b_viewports")


@query("t01_tile_demand", _demand_sql("[s6]"))
def _(b: Bridge) -> DataFrame:
    result = SV.tile_demand(_stream(b, "b_viewports"), b.levels, "6 hours")
    done = sinks.append_result(b.spark, result)
    return done.select(F.unix_micros("window_start").alias("window_us"), "slide_id", "level", "col", "row", "views")


@query("t01_tile_demand_sliding", _demand_sql("[s3, s3 - INTERVAL 3 HOURS]"))
def _(b: Bridge) -> DataFrame:
    result = SV.tile_demand(_stream(b, "b_viewports"), b.levels, "6 hours", "3 hours")
    done = sinks.append_result(b.spark, result)
    return done.select(F.unix_micros("window_start").alias("window_us"), "slide_id", "level", "col", "row", "views")


@query("t02_viewing_sessions", oracle("""
    SELECT viewer_id, epoch_us(min(ts)) AS start_us, count(*) AS tiles_shown, epoch_us(max(ts)) - epoch_us(min(ts)) AS duration_us FROM (
        SELECT *, sum(fresh) OVER (PARTITION BY viewer_id ORDER BY ts) AS session FROM (
            SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY viewer_id ORDER BY ts) <= INTERVAL 3 HOURS THEN 0 ELSE 1 END AS fresh FROM b_visible))
    GROUP BY viewer_id, session
    HAVING max(ts) + INTERVAL 3 HOURS <= (SELECT max(ts) FROM b_viewports WHERE scale > 0) - INTERVAL 5 MINUTES""", "b_visible", "b_viewports"))
def _(b: Bridge) -> DataFrame:
    return sinks.append_result(b.spark, SV.viewing_sessions(_stream(b, "b_viewports"), b.levels, "3 hours")).select(
        "viewer_id", F.unix_micros("session_start").alias("start_us"), "tiles_shown", "duration_us"
    )


@query("t03_ingest_stream", """
    SELECT DISTINCT concat(s_name, '.pyramid') AS pyramid, 'done' AS status, 'complete' AS state FROM supplier""")
def _(b: Bridge) -> DataFrame:
    from slidelake.plans.catalog_planning import _write_files

    root, built = scratch_path(b.spark, "arrivals"), scratch_path(b.spark, "ingested")
    files = b.table("supplier").selectExpr(
        "explode(array(concat(s_name, '.svs'), concat(s_name, '.txt'), concat(s_name, '.tiff'))) AS path", "encode(s_name, 'utf-8') AS content"
    )
    _write_files(files, root)

    def build(plan: DataFrame) -> DataFrame:
        """Pyramids of 20 x 12 px images, in the colour of the pyramid's name."""
        images = plan.select(
            "slide_id", F.lit(20).alias("width"), F.lit(12).alias("height"),
            F.unhex(F.repeat(F.substring(F.md5("pyramid"), 1, 6), 240)).alias("rgb"),
        )
        slides = plan.select("slide_id", "path", F.create_map(F.lit("aperio.MPP"), F.lit("0.5")).alias("props"))
        return build_job(images, slides, built, tile_size=8).join(plan.select("slide_id", "pyramid"), "slide_id")

    arrivals = state.listing_stream(b.spark, root, per_trigger=max(10, files.count() // 3))
    sinks.run_bounded(state.ingest_stream(arrivals, root + "-catalog", root + "-checkpoint", build))
    done = b.spark.read.parquet(root + "-catalog").select(F.col("slide_id").cast("string").alias("slide_id"), "pyramid", "status")
    listing = cut_lineage(pyramid_listing(b.spark, built))
    found = pyramid_status(done.select("slide_id"), listing, pyramid_documents(listing, built))
    return done.join(shuffled(found.select("slide_id", F.col("status").alias("state"))), "slide_id").select("pyramid", "status", "state")


STEPS = 5


def _steps(b: Bridge, name: str) -> DataFrame:
    """A derived table in the steps it is delivered in: some rows come late, some twice."""
    rows = b.derived(name)
    last = rows.agg(F.max("seq")).first()[0] or 0
    due = F.floor(STEPS * F.col("seq") / F.lit(last + 1)).cast("int")
    first = rows.withColumn("step", F.when(F.col("seq") % 97 == 0, STEPS - 1).otherwise(due))
    again = first.filter(f"seq % 50 = 1 AND step < {STEPS - 1}").withColumn("step", F.col("step") + 1)
    return first.unionByName(again)


_STEPS = f"""SELECT * REPLACE (CASE WHEN seq % 97 = 0 THEN {STEPS - 1} ELSE step END AS step) FROM (
            SELECT *, {STEPS} * seq // (SELECT max(seq) + 1 FROM b_requests) AS step FROM b_requests)"""


def _deliver(b: Bridge, name: str, start) -> None:
    """Bring a table's steps to a folder and follow it; each step is one micro-batch of a stream started anew."""
    staged, arrived = scratch_path(b.spark, "steps"), scratch_path(b.spark, "arrived")
    _steps(b, name).write.partitionBy("step").parquet(staged)
    rows = b.derived(name)
    for step in range(STEPS):
        b.spark.read.schema(rows.schema).parquet(f"{staged}/step={step}").write.mode("append").parquet(arrived)
        sinks.run_bounded(start(b.spark.readStream.schema(rows.schema).parquet(arrived)))


def _follow_requests(b: Bridge, operator) -> DataFrame:
    """What an operator on request streams puts out, all steps together."""
    path = scratch_path(b.spark, "stream")
    schemas = []

    def start(stream: DataFrame):
        result = operator(stream.withColumnRenamed("row_", "row").withColumn("ts", F.col("ts").cast("timestamp")))
        schemas.append(result.schema)
        return sinks.to_table(result, path + "/out", path + "/checkpoint")

    _deliver(b, "b_requests", start)
    return b.spark.read.schema(schemas[-1]).parquet(path + "/out")


@query("t04_dedupe_in_flight", oracle("""
    SELECT viewer_id, generation, slide_id, level, col, row_ AS "row", count(*) AS n FROM (
        SELECT DISTINCT viewer_id, generation, slide_id, level, col, row_ FROM b_requests) GROUP BY ALL""", "b_requests"))
def _(b: Bridge) -> DataFrame:
    # The watermark stays before all rows, so nothing expires: one row per key.
    done = _follow_requests(b, lambda s: SV.dedupe_in_flight(s, "40 days"))
    return done.groupBy("viewer_id", "generation", "slide_id", "level", "col", "row").agg(F.count(F.lit(1)).alias("n"))


@query("t04_drop_stale_generations", oracle(f"""
    SELECT viewer_id, seq, generation FROM (
        SELECT *, max(generation) OVER (PARTITION BY viewer_id ORDER BY step) AS newest FROM (
            SELECT * FROM ({_STEPS}) UNION ALL
            SELECT * REPLACE (step + 1 AS step) FROM ({_STEPS}) WHERE seq % 50 = 1 AND step < {STEPS - 1}))
    WHERE generation = newest""", "b_requests"))
def _(b: Bridge) -> DataFrame:
    done = _follow_requests(b, lambda s: SV.drop_stale_generations(s, "40 days", "40 days"))
    return done.select("viewer_id", "seq", "generation")


@query("t04_dedupe_stream", oracle(f"""
    SELECT viewer_id, generation, slide_id, level, col, row_ AS "row", count(*) AS n FROM (
        SELECT *, max(generation) OVER (PARTITION BY viewer_id ORDER BY step) AS newest FROM (
            SELECT viewer_id, generation, slide_id, level, col, row_, min(step) AS step FROM ({_STEPS}) GROUP BY ALL))
    WHERE generation = newest GROUP BY ALL""", "b_requests"))
def _(b: Bridge) -> DataFrame:
    done = _follow_requests(b, lambda s: SV.dedupe_stream(s, "40 days", "40 days"))
    return done.groupBy("viewer_id", "generation", "slide_id", "level", "col", "row").agg(F.count(F.lit(1)).alias("n"))


def _edits(rows: DataFrame) -> DataFrame:
    return rows.select(
        "slide_id", "seq", "op", "annotation_id", F.col("grp").alias("group"), F.lit("point").alias("type"),
        F.expr("array(named_struct('x', px, 'y', px + 1))").alias("coordinates"), "label", "color",
    )


def _edit_state(b: Bridge) -> DataFrame:
    path = scratch_path(b.spark, "edits")
    table = state.annotation_table(_edits(b.derived("b_changes")), path + "/table", every=2)
    _deliver(b, "b_changes", lambda s: state.follow_annotations(_edits(s), table, path + "/checkpoint"))
    return table.read()


_LIVE = """
    SELECT slide_id, annotation_id, grp FROM (
        SELECT *, row_number() OVER (PARTITION BY slide_id, annotation_id ORDER BY seq) AS nth FROM b_changes WHERE op = 'add') c
    WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM b_changes d WHERE d.slide_id = c.slide_id AND d.seq > c.seq AND (
        (d.op = 'delete' AND d.annotation_id = c.annotation_id) OR (d.op = 'delete_group' AND d.grp = c.grp) OR d.op = 'clear'))"""


@query("t05_annotation_state", oracle(f"SELECT slide_id, annotation_id, grp AS \"group\" FROM ({_LIVE})", "b_changes"))
def _(b: Bridge) -> DataFrame:
    return state.live_annotations(_edit_state(b)).select("slide_id", "annotation_id", "group")


@query("t05_live_group_counts", oracle(f"SELECT slide_id, grp AS \"group\", count(*) AS n FROM ({_LIVE}) GROUP BY ALL", "b_changes"))
def _(b: Bridge) -> DataFrame:
    return state.live_group_counts(_edit_state(b))


def _status_state(b: Bridge) -> DataFrame:
    path = scratch_path(b.spark, "status")
    table = state.status_table(b.derived("b_status"), path + "/table", every=2)
    _deliver(b, "b_status", lambda s: state.follow_status(s, table, path + "/checkpoint"))
    return table.read().drop("seq")


@query("t06_batch_status", oracle(_LATEST, "b_status"))
def _(b: Bridge) -> DataFrame:
    return _status_state(b).withColumn("progress", F.round("progress", 6))


@query("t06_status_counts", oracle(f"SELECT status, count(*) AS files FROM ({_LATEST}) GROUP BY status", "b_status"))
def _(b: Bridge) -> DataFrame:
    return state.status_counts(_status_state(b))
