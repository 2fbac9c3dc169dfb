import os
import time
from datetime import datetime, timedelta

import pytest
from compare import rows
from pyspark.sql import functions as F

from slidelake.operators import annotations as A
from slidelake.operators.annotations import merge_folds
from slidelake.streaming import sinks, state
from slidelake.streaming import viewports as SV

START = datetime(2024, 1, 1)
VIEW = ("viewer_id string, seq bigint, ts timestamp, slide_id bigint, x double, y double, width double, height double, scale double")


def feed(spark, folder, schema, *batches):
    """A stream that sees each batch as one file, in order."""
    for i, data in enumerate(batches):
        df = spark.createDataFrame(data, schema).coalesce(1)
        path = f"{folder}/in/{i:03d}"
        df.write.parquet(path)
        for name in os.listdir(path):
            os.utime(f"{path}/{name}", (1_700_000_000 + i * 60,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def view(viewer, seq, minute, x=0.0):
    return (viewer, seq, START + timedelta(minutes=minute), 1, x, 0.0, 100.0, 100.0, 1.0)


def test_late_viewports_are_dropped(spark, folder, three_levels):
    stream = feed(spark, folder, VIEW, [view("a", 1, 1), view("a", 2, 3)], [view("a", 3, 40)], [view("b", 4, 41)], [view("a", 5, 2), view("b", 6, 42)], [view("a", 7, 90)])
    done = sinks.append_result(spark, SV.tile_demand(stream, three_levels, "10 minutes", lateness="5 minutes"))
    got = rows(done.withColumn("m", ((F.unix_timestamp("window_start") - F.lit(int(START.timestamp()))) / 60).cast("int")), "m", "level", "col", "row", "views")
    # The update of minute 2 comes after the watermark has passed its window.
    assert [(m, v) for m, _, _, _, v in got] == [(0, 2), (40, 3)]


def test_sliding_windows_count_twice(spark, folder, three_levels):
    stream = feed(spark, folder, VIEW, [view("a", 1, 12)], [view("a", 2, 100)])
    done = sinks.append_result(spark, SV.tile_demand(stream, three_levels, "10 minutes", "5 minutes", "1 minute"))
    assert done.filter("views = 1").count() == 2


def test_sessions(spark, folder, three_levels):
    stream = feed(spark, folder, VIEW, [view("a", 1, 0), view("b", 2, 5)], [view("a", 3, 20), view("a", 4, 70)], [view("c", 5, 300)])
    done = sinks.append_result(spark, SV.viewing_sessions(stream, three_levels, "30 minutes"))
    got = rows(done.withColumn("minutes", (F.col("duration_us") / 60_000_000).cast("int")), "viewer_id", "tiles_shown", "minutes")
    assert got == [("a", 1, 0), ("a", 2, 20), ("b", 1, 0)]


REQUEST = "viewer_id string, seq bigint, ts timestamp, generation bigint, slide_id bigint, level int, col int, row int"


def request(seq, generation, col, viewer="v"):
    return (viewer, seq, START + timedelta(seconds=seq), generation, 1, 0, col, 0)


def test_in_flight_duplicates_and_old_generations(spark, folder):
    batches = [[request(1, 1, 0), request(2, 1, 0), request(3, 1, 1)], [request(4, 1, 1), request(5, 2, 1)], [request(6, 1, 7), request(7, 2, 2), request(8, 1, 3, "w")]]
    stream = feed(spark, folder, REQUEST, *batches)
    once = rows(sinks.append_result(spark, SV.dedupe_in_flight(stream)), "generation", "col")
    assert once == [(1, 0), (1, 1), (1, 3), (1, 7), (2, 1), (2, 2)]
    fresh = rows(sinks.append_result(spark, SV.drop_stale_generations(stream)), "seq")
    assert fresh == [(1,), (2,), (3,), (5,), (7,), (8,)]
    both = rows(sinks.append_result(spark, SV.dedupe_stream(stream)), "generation", "col")
    assert both == [(1, 0), (1, 1), (1, 3), (2, 1), (2, 2)]


def test_silent_viewers_are_forgotten(spark, folder):
    def at(seq, minute, generation, viewer="v"):
        return (viewer, seq, START + timedelta(minutes=minute), generation, 1, 0, 0, 0)

    batches = [
        [at(1, 0, 5), at(2, 0, 4), at(3, 0, 9, "w")],
        [at(4, 30, 4), at(5, 30, 9, "w"), ("v", 6, START + timedelta(minutes=30), None, 1, 0, 0, 0)],  # v: timer moves on
        [at(7, 70, 9, "w")],
        [at(8, 2, 9, "w")],  # later than the watermark
        [at(9, 95, 9, "w")],  # the watermark passes v's last request by an hour
        [at(10, 96, 9, "w"), at(11, 96, 1)],  # v starts anew
        [at(12, 97, 3, "w"), at(13, 97, 1), at(14, 97, 0)],
    ]
    stream = feed(spark, folder, REQUEST, *batches)
    got = rows(sinks.append_result(spark, SV.drop_stale_generations(stream, "1 minute", "1 hour")), "seq")
    assert got == [(1,), (3,), (5,), (7,), (9,), (10,), (11,), (13,)]


def test_many_viewers_share_states_and_keep_missing_values(spark, folder):
    """A call of Python serves a bucket of viewers; 2^53 + 1 and missing numbers come through unchanged."""
    big = 2**53 + 1
    step = lambda n: [(None if v == 0 else f"v{v}", 1000 * n + v, START + timedelta(seconds=n), v % 3 if n == 1 else 1,
                       None if v % 7 == 0 else big, 0, None if v % 5 == 0 else v, 0) for v in range(600)]
    stream = feed(spark, folder, REQUEST, step(1), step(2))
    query = sinks.to_table(SV.drop_stale_generations(stream, buckets=8), f"{folder}/out", f"{folder}/checkpoint")
    sinks.run_bounded(query)
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 9
    got = spark.read.parquet(f"{folder}/out")
    want = [r for r in step(1)] + [r for r in step(2) if r[1] % 1000 % 3 < 2]
    pick = lambda r: (r[1], r[0] or "", r[3], -1 if r[4] is None else r[4], -1 if r[6] is None else r[6])
    assert sorted(pick(tuple(r)) for r in got.select(*[c.split()[0] for c in REQUEST.split(", ")]).collect()) == sorted(map(pick, want))


EDIT = ("slide_id bigint, seq bigint, op string, annotation_id string, group string, type string, "
        "coordinates array<struct<x:double,y:double>>, label string, color string")


def edit(seq, op, ann=None, group=None, x=0.0, label=None):
    return (1, seq, op, ann, group, "point", [(x, x)], label, "#000000")


def test_edit_stream_equals_the_batch_fold(spark, folder):
    batches = [[edit(1, "add", "a", "g", 1.0), edit(2, "add", "b", "h", 2.0)],
               [edit(3, "set_coordinates", "a", x=9.0), edit(4, "delete", "b"), edit(5, "set_style", "b", label="gone"), edit(6, "set_style", "zzz", label="q")],
               [edit(7, "add", "c", "h", 3.0), edit(8, "delete_group", group="h"), edit(9, "add", "d", "h", 4.0), edit(10, "set_style", "a", label="new")]]
    stream = feed(spark, folder, EDIT, *batches)
    table = state.annotation_table(stream, f"{folder}/state", every=2)
    sinks.run_bounded(state.follow_annotations(stream, table, f"{folder}/checkpoint"))
    folded = table.read()
    live = state.live_annotations(folded).withColumn("x", F.get("coordinates", 0)["x"])
    same = ("annotation_id", "group", "x", "label")
    assert [r[:3] for r in rows(live.na.fill(""), *same)] == [("a", "g", 9.0), ("d", "h", 4.0)]
    everything = spark.createDataFrame([e for b in batches for e in b], EDIT)
    batch = A.apply_changes(everything.limit(0), everything).withColumn("x", F.get("coordinates", 0)["x"])
    assert rows(batch.na.fill(""), *same) == rows(live.na.fill(""), *same)
    assert rows(state.live_group_counts(folded), "group", "n") == [("g", 1), ("h", 1)]


def test_ended_annotations_keep_numbers_only(spark):
    log = [edit(1, "add", "a", "g", 1.0), edit(2, "set_style", "a", label="x"), edit(3, "delete", "a"), edit(4, "add", "b", "g", 2.0),
           edit(5, "delete", "b"), edit(6, "add", "b", "g", 3.0), edit(7, "clear"), edit(8, "add", "c", "g", 4.0), edit(9, "set_coordinates", "c", x=5.0)]
    df = spark.createDataFrame(log, EDIT)
    whole = state.live_annotations(A.fold_log(df)).select("annotation_id", "coordinates")
    parts = [A.fold_log(df.filter(F.col("seq") % 3 == i)) for i in (2, 0, 1)]
    merged = merge_folds(parts[0].unionByName(parts[1]))
    merged = merge_folds(merged.unionByName(parts[2]).unionByName(parts[0]))  # out of order, one part twice
    assert rows(state.live_annotations(merged).select("annotation_id", "coordinates"), "annotation_id", "coordinates") == rows(whole, "annotation_id", "coordinates")
    ended = merged.filter("entity_key IN ('a', 'b')")
    assert rows(ended, "entity_key", "removed_seq") == [("a", 3), ("b", 5)]
    assert ended.filter("created.coordinates IS NOT NULL OR moved IS NOT NULL OR styled IS NOT NULL").count() == 0


STATUS = "file string, seq bigint, status string, progress double, error string"


def test_compaction_late_rows_and_replays(spark, folder):
    def batch(*data):
        return state.newest_status(spark.createDataFrame(data, STATUS))

    empty = spark.createDataFrame([], STATUS)
    table = state.status_table(empty, f"{folder}/state", every=3, most=4)
    assert table.read().count() == 0
    table.compact()
    assert table.folders() == []
    steps = [batch(("x", 2, "processing", 0.1, None)), batch(("y", 3, "done", 1.0, None)), batch(("x", 9, "done", 1.0, None)),
             batch(("x", 5, "error", 0.5, "late")), batch(("y", 10, "error", 0.0, "bad"))]
    for number, rows_ in enumerate(steps[:3]):
        table.save(rows_, number)
        assert table.compact_if_due() == (number == 2)
    names = lambda: [f[len(table.path) + 1:] for f in table.folders()]
    assert names() == ["snapshots/2"]
    want = [("x", 9, "done"), ("y", 3, "done")]
    assert rows(table.read(), "file", "seq", "status") == want
    table.save(steps[2], 2)  # replayed after its snapshot
    table.save(steps[3], 3)
    table.save(steps[3], 3)  # replayed before one
    assert names() == ["snapshots/2", "batches/3"]
    assert rows(table.read(), "file", "seq", "status") == want
    # A job that died while writing leaves no mark and does not count.
    os.makedirs(f"{folder}/state/batches/4")
    os.makedirs(f"{folder}/state/snapshots/3")
    assert names() == ["snapshots/2", "batches/3"]
    table.save(steps[4], 4)
    table.compact()
    assert names() == ["snapshots/4"] and rows(table.read(), "file", "seq") == [("x", 9), ("y", 10)]
    assert sorted(os.listdir(f"{folder}/state/batches")) == ["3", "4"]  # what the snapshot before had replaced is gone
    assert sorted(os.listdir(f"{folder}/state/snapshots")) == ["2", "3", "4"]


def test_a_restarted_stream_compacts_as_it_goes(spark, folder):
    table = None
    for i in range(6):
        data = [(f"f{n}", 10 * i + n, "done" if (i + n) % 2 else "processing", i / 10, None) for n in range(i + 1)]
        spark.createDataFrame(data, STATUS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(STATUS).parquet(f"{folder}/in")
        table = state.status_table(stream, f"{folder}/state", every=2, share=0.0)
        sinks.run_bounded(state.follow_status(stream, table, f"{folder}/checkpoint"))
    assert [f[len(table.path) + 1:] for f in table.folders()] == ["snapshots/5"]
    assert rows(table.read(), "file", "seq") == [(f"f{n}", 50 + n) for n in range(6)]


def test_status_stream(spark, folder):
    stream = feed(spark, folder, STATUS, [("x", 1, "processing", 0.1, None), ("y", 2, "done", 1.0, None)], [("x", 3, "error", 0.4, "bad")])
    table = state.status_table(stream, f"{folder}/state")
    sinks.run_bounded(state.follow_status(stream, table, f"{folder}/checkpoint"))
    newest = table.read()
    assert rows(newest.na.fill(""), "file", "status", "error") == [("x", "error", "bad"), ("y", "done", "")]
    assert rows(state.status_counts(newest), "status", "files") == [("done", 1), ("error", 1)]


def test_arrivals_are_built_once(spark, folder):
    def arrive(*names):
        os.makedirs(f"{folder}/in", exist_ok=True)
        for n in names:
            with open(f"{folder}/in/{n}", "w") as out:
                out.write("x")
        time.sleep(0.1)
        sinks.run_bounded(state.ingest_stream(state.listing_stream(spark, f"{folder}/in"), f"{folder}/catalog", f"{folder}/checkpoint"))

    arrive("a.svs", "b.tif", "notes.txt")
    arrive("a.tiff", "c.NDPI")
    assert rows(spark.read.parquet(f"{folder}/catalog"), "batch_id", "pyramid") == [(0, "a.pyramid"), (0, "b.pyramid"), (1, "c.pyramid")]


def test_long_streams_are_no_error_and_stuck_ones_are(spark, folder):
    for i in range(4):
        spark.range(1).coalesce(1).write.parquet(f"{folder}/in/{i}")
    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")

    def started(name, wait):
        return stream.writeStream.foreachBatch(lambda batch, n: time.sleep(wait)).option(
            "checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()

    query = started("long", 4)
    sinks.run_bounded(query, timeout=10)
    assert len(query.recentProgress) == 4
    with pytest.raises(TimeoutError, match="no further"):
        sinks.run_bounded(started("stuck", 25), timeout=8)


def test_a_build_reads_its_plan_not_the_arrivals(spark, folder):
    os.makedirs(f"{folder}/in")
    for n in ("a.svs", "b.tif"):
        with open(f"{folder}/in/{n}", "w") as out:
            out.write("x")
    read = []

    def build(plan):
        read.extend(plan.inputFiles())
        return plan

    sinks.run_bounded(state.ingest_stream(state.listing_stream(spark, f"{folder}/in"), f"{folder}/catalog", f"{folder}/checkpoint", build))
    assert read and not [f for f in read if f"{folder}/in/" in f]
    assert spark.read.parquet(f"{folder}/catalog").count() == 2
