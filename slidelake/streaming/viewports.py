"""Viewport and tile request streams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from slidelake.operators.viewport import visible_tiles
from slidelake.session import rocksdb_state


def tile_demand(
    stream: DataFrame, levels: DataFrame, window: str = "10 minutes", slide: str | None = None,
    lateness: str = "5 minutes", edge: str = "trunc",
) -> DataFrame:
    """How often each tile is on screen per event-time window; late viewports drop out.

    ``stream`` carries ``ts TIMESTAMP`` and the viewport columns; ``levels`` is
    static.
    """
    tiles = visible_tiles(stream.withWatermark("ts", lateness), levels, edge)
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    return tiles.groupBy(span.alias("w"), "slide_id", "level", "col", "row").agg(
        F.count(F.lit(1)).alias("views")
    ).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
        "slide_id", "level", "col", "row", "views",
    )


def viewing_sessions(stream: DataFrame, levels: DataFrame, gap: str = "30 minutes",
                     lateness: str = "5 minutes", edge: str = "trunc") -> DataFrame:
    """Viewing sessions separated by a gap: tiles shown and duration."""
    tiles = visible_tiles(stream.withWatermark("ts", lateness), levels, edge)
    return tiles.groupBy(F.session_window("ts", gap).alias("s"), "viewer_id").agg(
        F.count(F.lit(1)).alias("tiles_shown"),
        F.min("ts").alias("started"), F.max("ts").alias("ended"),
    ).select(
        "viewer_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
        "tiles_shown",
        (F.unix_micros("ended") - F.unix_micros("started")).alias("duration_us"),
    )


def dedupe_in_flight(requests: DataFrame, lateness: str = "5 minutes") -> DataFrame:
    """Drop repeated requests for a tile of the same viewer and generation within the watermark."""
    return requests.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(
        ["viewer_id", "generation", "slide_id", "level", "col", "row"]
    )


def newest_generation(columns: list[str], idle_ms: int):
    """Rows of the newest generation of each viewer of a bucket; a viewer is forgotten after a silence.

    The state lists the bucket's viewers with their newest generation and the time their silence ends.
    Only rows of the newest generations seen so far are held while a batch is read.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        nobody = key[0] < 0  # the rows without a viewer have a bucket of their own
        name = lambda p: pd.Series(0, p.index) if nobody else p["viewer_id"]
        newest, due = {}, {}
        for viewer, top, end in zip(*state.get) if state.exists else ():
            if end >= now:  # rows come before time-outs, but a viewer's time may be up already
                newest[0 if nobody else viewer], due[0 if nobody else viewer] = top, end
        held: list[pd.DataFrame] = []
        for p in frames:
            if state.hasTimedOut or not len(p):
                continue
            seen = p.groupby(name(p)).agg({"generation": "max", "at_ms": "max"})
            for viewer, top, last in zip(seen.index.tolist(), seen["generation"].tolist(), seen["at_ms"].tolist()):
                newest[viewer] = max(newest.get(viewer, top), top)
                due[viewer] = max(due.get(viewer, 0), last + idle_ms)
            held.append(p[p["generation"] >= name(p).map(newest)])
        live = [viewer for viewer in newest if due[viewer] >= now]
        if live:
            state.update(([None if nobody else viewer for viewer in live], [newest[v] for v in live], [due[v] for v in live]))
            state.setTimeoutTimestamp(min(due[v] for v in live))
        elif state.exists:
            state.remove()
        for p in held:
            yield p.loc[p["generation"] == name(p).map(newest), columns]

    return run


def drop_stale_generations(
    requests: DataFrame, lateness: str | None = "5 minutes", idle: str = "1 day", buckets: int = 1024
) -> DataFrame:
    """Drop requests of an older generation than the viewer's newest one so far.

    A micro-batch's rows of a viewer are compared with the maximum including that
    batch.  The state is one number and one time a viewer; it ends when the watermark
    passes the viewer's last request by ``idle``, and a viewer who comes back later starts
    anew.  Requests later than ``lateness``, and those without ``ts`` or ``generation``,
    drop out.  ``lateness`` is None where the stream has a watermark on ``ts`` already.

    Viewers share ``buckets`` states, so that a micro-batch costs so many calls of Python and not one for
    each viewer.  A bucket's list is written anew when one of its viewers is seen: many millions of
    viewers want more buckets, and a stream keeps the number it was started with.
    """
    rocksdb_state(requests.sparkSession)
    columns = ["viewer_id", "seq", "ts", "generation", "slide_id", "level", "col", "row"]
    types = {c: requests.schema[c].dataType for c in columns}
    timed = requests if lateness is None else requests.withWatermark("ts", lateness)
    # Pandas has no missing integers, so these travel as 0 with a bit that says so.
    gaps = [c for c in columns if isinstance(types[c], T.IntegralType) and c not in ("viewer_id", "generation")]
    bits = [F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(gaps)]
    bucket = F.when(F.col("viewer_id").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("viewer_id"), F.lit(buckets)).cast("int"))
    known = timed.filter("generation IS NOT NULL AND ts IS NOT NULL").select(
        *[F.coalesce(c, F.lit(0).cast(types[c])).alias(c) if c in gaps else c for c in columns],
        reduce(lambda a, b: a + b, bits, F.lit(0)).alias("missing"), F.unix_millis("ts").alias("at_ms"), bucket.alias("bucket"),
    )
    idle_ms = int(pd.Timedelta(idle) / pd.Timedelta("1 ms"))
    kept = known.groupBy("bucket").applyInPandasWithState(
        newest_generation([*columns, "missing"], idle_ms),
        ", ".join(f"`{c}` {types[c].simpleString()}" for c in columns) + ", missing int",
        f"viewers array<{types['viewer_id'].simpleString()}>, newest array<bigint>, due array<bigint>",
        "append", GroupStateTimeout.EventTimeTimeout,
    )
    return kept.select(*[
        F.when(F.col("missing").bitwiseAND(F.lit(1 << gaps.index(c))) == 0, F.col(c)).alias(c) if c in gaps else c for c in columns
    ])


def dedupe_stream(requests: DataFrame, lateness: str = "5 minutes", idle: str = "1 day") -> DataFrame:
    """First request per tile of each viewer's newest generation, as requests arrive."""
    return drop_stale_generations(dedupe_in_flight(requests, lateness), None, idle)
