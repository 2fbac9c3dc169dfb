"""Elements of one array of a huge JSON document, found by scanning byte ranges in parallel.

A range does not know whether it starts inside a string or how deep.  So each is
summarised for every possible start (inside a string or not, after a backslash or
not), the summaries are chained per file, and a second scan with the true start
finds the borders of the root's members and of their elements.  Only summaries
of a few numbers a range meet in one task; the text is never shuffled.

Borders are found by brackets and quotes alone.  Whether an element is right is left to its reader.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidelake.session import cut_lineage
from slidelake.sources.files import open_store

_QUOTE, _ESCAPE, _COMMA = b'"\\,'
_STEP = np.zeros(256, np.int8)
_STEP[list(b"{[")] = 1
_STEP[list(b"}]")] = -1
_MARK = _STEP != 0
_MARK[_COMMA] = True
_KEY = re.compile(rb'\s*("(?:[^"\\]|\\.)*")\s*:\s*', re.S)


class Scan:
    """Brackets and commas of a byte range that lie outside strings, for a given start."""

    def __init__(self, raw: np.ndarray, in_string: int, escaped: int) -> None:
        slashes = np.flatnonzero(raw == _ESCAPE)
        starts = slashes[np.diff(slashes, prepend=-2) != 1]

        def after_backslash(at: np.ndarray) -> np.ndarray:
            """Whether an odd run of backslashes lies right before the positions."""
            run = np.zeros(len(at), np.int64)
            if len(slashes):
                behind = np.flatnonzero((at > 0) & (raw[np.maximum(at, 1) - 1] == _ESCAPE))
                run[behind] = at[behind] - starts[np.searchsorted(starts, at[behind] - 1, "right") - 1]
            return ((run + escaped * (run == at)) & 1).astype(bool)

        quotes = np.flatnonzero(raw == _QUOTE)
        quotes = quotes[~after_backslash(quotes)]
        marks = np.flatnonzero(_MARK[raw])
        self.at = marks[((np.searchsorted(quotes, marks) + in_string) & 1) == 0]
        self.byte = raw[self.at]
        self.step = _STEP[self.byte].astype(np.int64)
        self.in_string = (len(quotes) + in_string) & 1
        self.escaped = int(after_backslash(np.array([len(raw)]))[0])


def _bytes(store_path: str, start: int, end: int) -> bytes:
    store, name = open_store(store_path)
    with store.open_input_file(name) as file:
        return file.read_at(end - start, start)


_SUMMARY = ", ".join(f"string{k} int, escape{k} int, depth{k} bigint" for k in range(4))


def _summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for path, chunk, start, end in zip(f["path"], f["chunk"], f["start"], f["end"]):
            raw = np.frombuffer(_bytes(path, start, end), np.uint8)
            row = [path, chunk, start, end]
            for k in range(4):
                scan = Scan(raw, k & 1, k >> 1)
                row += [scan.in_string, scan.escaped, int(scan.step.sum())]
            rows.append(row)
        names = ["path", "chunk", "start", "end"] + [f"{n}{k}" for k in range(4) for n in ("string", "escape", "depth")]
        yield pd.DataFrame(rows, columns=names)


def _chain(f: pd.DataFrame) -> pd.DataFrame:
    """True start of every range of a file, and what its last one ends with."""
    f = f.sort_values("chunk").reset_index(drop=True)
    state, depth = 0, 0
    rows = []
    for i, chunk in enumerate(f.to_dict("records")):
        before = (state & 1, state >> 1, depth)
        depth += chunk[f"depth{state}"]
        state = chunk[f"string{state}"] + 2 * chunk[f"escape{state}"]
        rows.append((chunk["path"], chunk["chunk"], chunk["start"], chunk["end"], *before, depth == 0 and state == 0 if i == len(f) - 1 else None))
    return pd.DataFrame(rows, columns=["path", "chunk", "start", "end", "in_string", "escaped", "depth", "closed"])


def _borders(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["path", "chunk", "root", "root_bytes", "closes", "commas", "sound"]
    for f in frames:
        for path, chunk, start, end, in_string, escaped, depth, closed in f.itertuples(index=False):
            scan = Scan(np.frombuffer(_bytes(path, start, end), np.uint8), in_string, escaped)
            after = depth + np.cumsum(scan.step)
            before = after - scan.step
            comma, at = scan.byte == _COMMA, scan.at + start
            # The root's brackets, the commas between its members, and what else lies outside it.
            root = (before == 0) | (after == 0) | comma & (after == 1)
            sound = bool((after >= 0).all()) and (pd.isna(closed) or bool(closed))
            row = (path, chunk, at[root], scan.byte[root].astype(np.int32), at[(scan.byte == ord("]")) & (after == 1)], at[comma & (after == 2)], sound)
            yield pd.DataFrame([row], columns=names)


def _member(path: str, start: int, end: int) -> tuple[str | None, int, bytes]:
    """Key of the member in a range, place of its value, and the value's first bytes."""
    size = 1 << 12
    while True:
        text = _bytes(path, start, min(end, start + size))
        found = _KEY.match(text)
        if found and (found.end() < len(text) or start + size >= end):
            try:
                return json.loads(found[1]), start + found.end(), text[found.end():]
            except ValueError:
                return None, start, b""
        if start + size >= end:
            return None, start, b""
        size *= 4


def _find_array(key: str, counter: str):
    """Span of the array that the root holds under a key, or the reason why there is none."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("chunk")
        path = f["path"].iloc[0]
        every = lambda c: np.concatenate([np.asarray(v, np.int64) for v in f[c]])
        root, kinds, closes = every("root"), every("root_bytes"), every("closes")
        reason, first, span = None, 0, (None, None)
        if not f["sound"].all() or len(kinds) < 2 or list(kinds[kinds != _COMMA]) != [ord("{"), ord("}")] or _COMMA in kinds[[0, -1]]:
            reason = "malformed JSON"
        else:
            known = set()
            for a, b in zip(root[:-1], root[1:]):
                name, at, value = _member(path, int(a) + 1, int(b))
                if name == counter and (number := re.fullmatch(rb"(-?\d+)\s*", value)):
                    first = int(number[1])
                if name == key and key not in known and value[:1] == b"[":
                    place = np.searchsorted(closes, at)
                    if place < len(closes):
                        span = (at, int(closes[place]))
                    else:
                        reason = "malformed JSON"
                known.add(name)
            if key not in known:
                reason = f"missing {key}"
        return pd.DataFrame([(path, reason, first, *span)], columns=["path", "reason", "first", "open", "close"]).astype({"open": "Int64", "close": "Int64"})

    return run


def _elements(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for path, before, number, total, ends in zip(f["path"], f["before"], f["number"], f["total"], f["ends"]):
            start = int(before) + 1
            text = _bytes(path, start, int(ends[-1]))
            cuts = np.concatenate([[start - 1], np.asarray(ends, np.int64)])
            if total == 1 and not text.strip():
                continue  # an array without elements has one border, behind nothing
            for at in range(0, len(ends), 10_000):
                part = [text[a + 1 - start : b - start].decode("utf-8", "replace").strip() for a, b in zip(cuts[at : at + 10_000], cuts[at + 1 : at + 10_001])]
                yield pd.DataFrame({"path": path, "pos": int(number) + at + np.arange(len(part)), "element": part})


def array_elements(files: DataFrame, key: str, counter: str = "first_position", chunk_bytes: int = 16 << 20) -> tuple[DataFrame, DataFrame]:
    """``(path, length)`` of JSON files to ``(path, pos, element)`` and ``(path, reason)`` of files without such an array.

    ``pos`` counts from the number under ``counter``, if the root has one.  The
    first member of a name counts.  A task holds one range and at most one element that reaches beyond it.
    """
    ranges = files.select(
        "path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("length") / chunk_bytes) - 1, F.lit(0).cast("bigint")))).alias("chunk")
    ).select(
        "path", "chunk", (F.col("chunk") * chunk_bytes).alias("start"), F.least((F.col("chunk") + 1) * chunk_bytes, "length").alias("end")
    )
    # Work goes by bytes and not by rows: as many tasks as ranges, up to several rounds of the cluster.
    width = 8 * int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = lambda df: df.repartition(width, "path", "chunk")
    place = "path string, chunk bigint"
    summaries = cut_lineage(spread(ranges).mapInPandas(_summaries, f"{place}, start bigint, end bigint, {_SUMMARY}"))
    starts = summaries.groupBy("path").applyInPandas(
        _chain, f"{place}, start bigint, end bigint, in_string int, escaped int, depth bigint, closed boolean"
    )
    borders = cut_lineage(spread(starts).mapInPandas(
        _borders, f"{place}, root array<bigint>, root_bytes array<int>, closes array<bigint>, commas array<bigint>, sound boolean"
    ))
    found = cut_lineage(borders.drop("commas").groupBy("path").applyInPandas(
        _find_array(key, counter), "path string, reason string, first bigint, open bigint, close bigint"
    ))
    inside = borders.join(found.filter("open IS NOT NULL"), "path").withColumn(
        "ends", F.expr("array_sort(concat(filter(commas, c -> c > open AND c < close), filter(closes, c -> c = close)))")
    ).filter(F.size("ends") > 0).select("path", "chunk", "first", "open", "ends")
    # One row a range: what came before it is the last border and a number of elements.
    order = Window.partitionBy("path").orderBy("chunk")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    counted = inside.select(
        "path", "chunk", "ends",
        F.coalesce(F.lag(F.element_at("ends", -1)).over(order), "open").alias("before"),
        (F.col("first") + F.coalesce(F.sum(F.size("ends")).over(earlier), F.lit(0))).alias("number"),
        F.sum(F.size("ends")).over(Window.partitionBy("path")).alias("total"),
    )
    elements = spread(counted).mapInPandas(_elements, "path string, pos bigint, element string")
    return elements, found.filter("reason IS NOT NULL").select("path", "reason")
