"""Long repeated byte strings found with run-length compressed suffix indexes.

All windows of ``LENGTH`` bytes that hold the same minimal k-gram meet in one
group.  A group with a single string is settled by its digest; the others are
indexed: a Burrows-Wheeler transform with sampled run ends gives the longest
match of every position (its matching statistics) in one stream over the text,
since a match only changes other than by one at a run's end.  Groups with too
many strings meet anew under longer k-grams, up to the window itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.llm.batches import Batch, documents_of, pack, release_memory, shuffle_width
from slidelake.llm.superkmers import _pack, _unpack, ranges
from slidelake.llm.textops import _powers, hash_runs, mix, runs, spread, window_min
from slidelake.session import cut_lineage

LENGTH = 400
GRAM = 64
#: A group with more different strings than this is split under longer k-grams.
HOT_STRINGS = 1000
#: Text that one index holds; groups are whole, so an index may exceed it by a group.
INDEX_BYTES = 1 << 19
BUCKETS_EACH = 8
#: Bytes that `cut` works on at once; its arrays take some 100 times as much.
_PIECE = 1 << 18
_MAX_WINDOWS = 1024  # of one string, so that periodic text gives short strings too
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

# What a group's bucket says of a batch's string.
KNOWN, INDEX, SPLIT = 0, 1, 2


def cut(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Maximal runs of windows sharing a minimal k-gram: ``start``, ``windows``, ``anchor``, a 128-bit digest, ``inner`` repeats possible.

    Works on ranges of the buffer, a piece at a time; a window lies in one range.
    """
    found = {name: [] for name in ("start", "windows", "anchor", "d1", "d2", "inner")}
    held: list[tuple[int, int]] = []
    size = 0

    def work():
        if not held:
            return
        text = np.concatenate([buf[s:e] for s, e in held])
        lens = np.array([e - s for s, e in held])
        off = np.concatenate(([0], np.cumsum(lens)))
        values = _CODES[text]
        grams = hash_runs(values, gram)
        least = window_min(grams, length - gram + 1)
        at = ranges(off[:-1], lens - length + 1)
        key = least[at]
        new = np.concatenate(([True], (np.diff(at) != 1) | (key[1:] != key[:-1])))
        new |= (np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))) % _MAX_WINDOWS == 0
        head = np.flatnonzero(new)
        begin, count = at[head], np.diff(np.append(head, len(at)))
        piece = np.searchsorted(off, begin, "right") - 1
        end = begin + count + length - 1
        found["start"].append(begin - off[piece] + np.array([s for s, _ in held])[piece])
        found["windows"].append(count)
        found["anchor"].append(key[head])
        # A string can only repeat itself if its minimal k-gram occurs in it twice.
        # A k-gram is minimal somewhere if it equals the largest minimum around it.
        around = ~window_min(~np.concatenate((np.zeros(length - gram, np.uint64), least, np.zeros(length - gram, np.uint64))), length - gram + 1)
        minimal = np.flatnonzero(around == grams)
        low, high = np.searchsorted(minimal, begin), np.searchsorted(minimal, end - gram, "right")
        each = np.repeat(np.arange(len(begin)), high - low)
        equal = grams[minimal[ranges(low, high - low)]] == key[head][each]
        found["inner"].append(np.bincount(each[equal], minlength=len(begin)) > 1)
        for seed, name in ((0, "d1"), (1, "d2")):
            total = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values * _powers(len(values), seed, False), out=total[1:])
            sums = (total[end] - total[begin]) * _powers(len(values), seed, True)[begin]
            found[name].append(mix(sums + (end - begin).astype(np.uint64)))

    for s, e in zip(starts.tolist(), ends.tolist()):
        while e - s >= length:
            stop = min(e, s + _PIECE + length - 1)
            if held and size + stop - s > _PIECE:
                work()
                held, size = [], 0
            held.append((s, stop))
            size += stop - s
            s = stop - length + 1
    work()
    kinds = {"start": np.int64, "windows": np.int64, "inner": bool}
    return {k: np.concatenate(v) if v else np.zeros(0, kinds.get(k, np.uint64)) for k, v in found.items()}


def _intervals(**more: np.ndarray) -> bytes:
    return _pack(**{k: v.astype(np.uint8 if k == "need" else np.uint64 if k == "anchor" else np.int64) for k, v in more.items()})


def _ask(batch: Batch, starts: np.ndarray, ends: np.ndarray, length: int, gram: int, buckets: int) -> list[tuple]:
    """One entry per different string of the batch by bucket, and what the batch knows itself (bucket -1)."""
    s = cut(batch.buf, starts, ends, length, gram)
    if not len(s["start"]):
        return []
    order = np.lexsort((s["d2"], s["d1"], s["anchor"]))
    same = np.ones(len(order) - 1, bool)
    for key in ("anchor", "d1", "d2"):
        same &= s[key][order[1:]] == s[key][order[:-1]]
    first = np.concatenate(([True], ~same))
    many = np.concatenate((~first[1:], [False]))  # another copy follows
    again = ~first | many
    rows = []
    if again.any():
        at = order[again]
        rows.append((batch.number, -1, _intervals(start=s["start"][at], windows=s["windows"][at])))
    at, many = order[first], many[first]
    bucket = (s["anchor"][at] % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:]):
        x = at[by[a:b]]
        rows.append((batch.number, int(bucket[by[a]]), _pack(
            start=s["start"][x].astype(np.int32), windows=s["windows"][x].astype(np.int16), many=many[by[a:b]].astype(np.uint8) + 2 * s["inner"][x].astype(np.uint8),
            anchor=s["anchor"][x], d1=s["d1"][x], d2=s["d2"][x],
        )))
    return rows


def _judge(group: pd.DataFrame, hot_strings: int, last: bool) -> list[tuple]:
    """Sort a bucket's strings by group and digest; tell each batch what is known, to be indexed or split."""
    parts = [_unpack(p) for p in group["payload"]]
    read = lambda name, kind: np.frombuffer(b"".join(p[name] for p in parts), kind)
    number = np.repeat(np.arange(len(parts)), [len(p["many"]) for p in parts])
    start, windows, many = read("start", np.int32).astype(np.int64), read("windows", np.int16).astype(np.int64), read("many", np.uint8)
    many, inner = many & 1 > 0, many & 2 > 0
    anchor, d1, d2 = read("anchor", np.uint64), read("d1", np.uint64), read("d2", np.uint64)
    order = np.lexsort((number, d2, d1, anchor))
    a = anchor[order]
    new_group = np.concatenate(([True], a[1:] != a[:-1]))
    new_text = new_group | np.concatenate(([True], (d1[order[1:]] != d1[order[:-1]]) | (d2[order[1:]] != d2[order[:-1]])))
    text = np.cumsum(new_text) - 1
    group_of = np.cumsum(new_group) - 1
    copies = np.bincount(text, 1 + many[order])
    repeated = copies > 1
    text_group = group_of[new_text]
    texts = np.bincount(text_group)
    open_texts = np.bincount(text_group, ~repeated)
    meet = ((texts > 1) | (np.bincount(group_of, inner[order]) > 0)) & (open_texts > 0)
    hot = meet & (texts > hot_strings) & (not last)
    known = repeated[text] & ~many[order]  # the batch knows its own repeats
    sender = new_text & meet[group_of]  # one copy stands for all
    out = []
    batches = group["batch"].to_numpy()
    for kind, mark in ((KNOWN, known), (INDEX, sender & ~hot[group_of]), (SPLIT, sender & hot[group_of])):
        at = order[mark]
        need = ~repeated[text[mark]]
        by = np.argsort(number[at], kind="stable")
        edges = np.flatnonzero(np.diff(number[at][by], prepend=-1, append=-1))
        for i, j in zip(edges[:-1], edges[1:]):
            x = at[by[i:j]]
            out.append((int(batches[number[x[0]]]), kind, _intervals(start=start[x], windows=windows[x], anchor=anchor[x], need=need[by[i:j]])))
    return out


class RunIndex:
    """Run-length compressed transform of several strings, with the suffixes at run ends."""

    def __init__(self, text: np.ndarray, lengths: np.ndarray):
        n = len(text)
        self.text, self.n = text, n
        self.ends = np.cumsum(lengths)
        self.owner = np.repeat(np.arange(len(lengths)), lengths)
        self.rest = self.ends[self.owner] - np.arange(n)  # bytes up to the string's end
        order = self._sort()
        # The byte before each suffix; a string's beginning ends every run.
        begins = self.rest == np.asarray(lengths)[self.owner]
        before = np.where(begins, -1, np.concatenate(([0], text[:-1].astype(np.int16))))[order]
        edge = np.flatnonzero((before[1:] != before[:-1]) | (before[1:] < 0) | (before[:-1] < 0)) + 1
        self.runs = len(edge) + 1
        self.above, self.below = order[edge - 1], order[edge]  # last suffix of a run, first of the next
        self.first, self.last = order[:1], order[-1:]
        self.common = self._common(self.above, self.below)

    def _sort(self) -> np.ndarray:
        """Suffix order by doubling; equal suffixes of several strings follow text order.

        Numbers that carry their place in the low bits are sorted as they are, which is far cheaper than sorting places by them.
        """
        n = self.n
        bits = n.bit_length()
        low = (1 << bits) - 1
        code = np.cumsum(np.bincount(self.text, minlength=256) > 0)
        width = int(code[-1]).bit_length()
        depth, longest = min(12, (63 - bits) // width), int(self.rest.max(initial=0))
        symbols = np.concatenate((code[self.text], np.zeros(depth, np.int64)))
        key = np.zeros(n, np.int64)
        for k in range(depth):
            key = key << width | np.where(self.rest > k, symbols[k : n + k], 0)
        key = key << bits | np.arange(n)
        key.sort()
        open_, key = key & low, key >> bits
        rank = np.empty(n, np.int64)
        new = np.append(True, key[1:] != key[:-1])[:n]
        rank[open_] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        # Only suffixes that still share their rank are sorted again.
        open_ = open_[~(new & np.append(new[1:], True)[:n])]
        while depth < longest and len(open_):
            ahead = np.minimum(open_ + depth, n - 1)
            key = rank[open_] << bits | np.where(self.rest[open_] > depth, rank[ahead] + 1, 0)
            each = np.arange(len(open_))
            if 3 * bits <= 63:
                key = key << bits | each
                key.sort()
                by, key = key & low, key >> bits
            else:
                by = np.argsort(key, kind="stable")
                key = key[by]
            open_ = open_[by]
            # A rank is the place of the group's first suffix, so places inside a group are free to fill.
            group = key >> bits
            new_group = np.append(True, group[1:] != group[:-1])
            new = np.append(True, key[1:] != key[:-1])
            head = lambda first: np.maximum.accumulate(np.where(first, each, 0))
            rank[open_] = group + head(new) - head(new_group)
            open_ = open_[~(new & np.append(new[1:], True))]
            depth *= 2
        key = rank << bits | np.arange(n)
        key.sort()
        return key & low

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common beginning of suffix pairs, inside their strings."""
        limit = np.minimum(self.rest[a], self.rest[b])
        out = np.zeros(len(a), np.int64)
        padded = np.concatenate((self.text, np.zeros(8, np.uint8)))
        eight = np.ndarray((self.n + 1,), "<u8", padded, strides=(1,))
        live = np.flatnonzero(limit > 0)
        while len(live):
            differ = eight[a[live] + out[live]] ^ eight[b[live] + out[live]]
            same = differ == 0
            low = differ & (~differ + np.uint64(1))
            step = np.where(same, 8, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) >> 3)
            out[live] += step
            live = live[same]
            live = live[out[live] < limit[live]]
        return np.minimum(out, limit)

    def matching_statistics(self) -> np.ndarray:
        """Longest match of every position with a suffix at any other place.

        One stream over the text for the neighbour above and one for the one
        below: from a sampled position on, the match shrinks by one per byte.
        """
        best = np.zeros(self.n, np.int64)
        for at, length, alone in ((self.below, self.common, self.first), (self.above, self.common, self.last)):
            sample = np.full(self.n, -1, np.int64)
            sample[at] = length
            sample[alone] = 0
            last = np.maximum.accumulate(np.where(sample >= 0, np.arange(self.n), 0))
            np.maximum(best, sample[last] - (np.arange(self.n) - last), out=best)
        return best


def _index(group: pd.DataFrame, length: int, index_bytes: int) -> list[tuple]:
    """Index a bucket's strings, some groups at a time, and answer with the windows that repeat."""
    parts = [_unpack(p) for p in group["payload"]]
    read = lambda name, kind: np.frombuffer(b"".join(p[name] for p in parts), kind)
    number = np.repeat(np.arange(len(parts)), [len(p["need"]) for p in parts])
    text, start, windows, anchor, need = read("text", np.uint8), read("start", np.int64), read("windows", np.int64), read("anchor", np.uint64), read("need", np.uint8) > 0
    lengths = windows + length - 1
    offset = np.concatenate(([0], np.cumsum(lengths)))
    order = np.argsort(anchor, kind="stable")
    group_ends = np.flatnonzero(np.append(anchor[order][1:] != anchor[order][:-1], True)) + 1
    found: dict[int, list[np.ndarray]] = {}

    def settle(x: np.ndarray):
        index = RunIndex(np.concatenate([text[offset[i] : offset[i + 1]] for i in x]), lengths[x])
        hit = index.matching_statistics() >= length
        hit &= need[x][index.owner]
        at = np.flatnonzero(hit)
        own = index.owner[at]
        where = start[x[own]] + at - (index.ends - lengths[x])[own]
        for k in np.unique(number[x[own]]):
            found.setdefault(int(k), []).append(where[number[x[own]] == k])

    begin = size = 0
    previous = 0
    for end in group_ends:
        add = int(lengths[order[previous:end]].sum())
        if previous > begin and size + add > index_bytes:
            settle(order[begin:previous])
            begin, size = previous, 0
        size += add
        previous = end
    if previous > begin:
        settle(order[begin:previous])
    batches = group["batch"].to_numpy()
    out = []
    for k, wheres in found.items():
        at = np.sort(np.concatenate(wheres))
        head = np.flatnonzero(np.diff(at, prepend=-9) != 1)
        out.append((int(batches[k]), KNOWN, _intervals(start=at[head], windows=np.diff(np.append(head, len(at))))))
    return out


def repeated_places(
    packed: DataFrame, length: int = LENGTH, gram: int = GRAM, hot_strings: int = HOT_STRINGS, buckets: int | None = None,
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """``(batch, answers)``: for each packed batch, the runs of window starts whose bytes occur elsewhere."""
    gram = min(gram, length)
    buckets = buckets or BUCKETS_EACH * shuffle_width(packed)
    reply = "batch bigint, kind int, payload binary"

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_judge(group, hot_strings, level >= length), columns=["batch", "kind", "payload"])

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hot = frame["units"] if "units" in frame else [None] * len(frame)
            for number, payload, units in zip(frame["batch"], frame["payload"], hot):
                batch = Batch(number, payload)
                starts, ends = batch.offsets[:-1], batch.offsets[1:]
                if units is not None:
                    told = [_unpack(u) for u in units]
                    starts = np.concatenate([np.frombuffer(t["start"], np.int64) for t in told])
                    ends = starts + np.concatenate([np.frombuffer(t["windows"], np.int64) for t in told]) + length - 1
                yield pd.DataFrame(_ask(batch, starts, ends, length, level, buckets), columns=["batch", "bucket", "payload"])
                release_memory()

    known, to_index, level, source = [], [], gram, packed.select("batch", "payload")
    while True:
        asked = cut_lineage(source.mapInPandas(ask, "batch bigint, bucket bigint, payload binary"))
        told = cut_lineage(asked.filter("bucket >= 0").groupBy("bucket").applyInPandas(judge, reply))
        known += [asked.filter("bucket < 0").select("batch", "payload"), told.filter(F.col("kind") == KNOWN).select("batch", "payload")]
        to_index.append(told.filter(F.col("kind") == INDEX).select("batch", "payload"))
        units = told.filter(F.col("kind") == SPLIT).groupBy("batch").agg(F.collect_list("payload").alias("units"))
        if level >= length or units.isEmpty():
            break
        level = length if length - level < 8 else (level + length + 1) // 2
        source = packed.select("batch", "payload").join(units, "batch")

    wanted = to_index[0]
    for more in to_index[1:]:
        wanted = wanted.unionByName(more)

    def ship(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, payload, lists in zip(frame["batch"], frame["payload"], frame["wanted"]):
                batch, told = Batch(number, payload), [_unpack(u) for u in lists]
                read = lambda name, kind: np.frombuffer(b"".join(t[name] for t in told), kind)
                start, windows, anchor, need = read("start", np.int64), read("windows", np.int64), read("anchor", np.uint64), read("need", np.uint8)
                bucket = (anchor % np.uint64(buckets)).astype(np.int64)
                by = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.diff(bucket[by], prepend=-1, append=-1))
                rows = []
                for a, b in zip(edges[:-1], edges[1:]):
                    x = by[a:b]
                    text = batch.buf[ranges(start[x], windows[x] + length - 1)]
                    rows.append((batch.number, int(bucket[x[0]]), _pack(text=text, start=start[x], windows=windows[x], anchor=anchor[x], need=need[x])))
                yield pd.DataFrame(rows, columns=["batch", "bucket", "payload"])

    def index(group: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame(_index(group, length, index_bytes), columns=["batch", "kind", "payload"])
        release_memory()
        return found

    shipped = packed.select("batch", "payload").join(
        wanted.groupBy("batch").agg(F.collect_list("payload").alias("wanted")), "batch"
    ).mapInPandas(ship, "batch bigint, bucket bigint, payload binary")
    answers = shipped.groupBy("bucket").applyInPandas(index, reply).select("batch", "payload")
    for more in known:
        answers = answers.unionByName(more)
    return answers.groupBy("batch").agg(F.collect_list("payload").alias("answers"))


def _covered(batch: Batch, answers, length: int) -> np.ndarray:
    marked = np.zeros(len(batch.buf), bool)
    for told in map(_unpack, answers if answers is not None else []):
        marked[ranges(np.frombuffer(told["start"], np.int64), np.frombuffer(told["windows"], np.int64))] = True
    return spread(marked, length, len(marked))


def remove_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of every row of ``docs(doc_id, text)``.

    Bytes go when a string of ``length`` bytes around them starts at any other
    place too.  Null texts are empty; every row is a text of its own, so a
    repeated row loses what it shares with its copy; ids may be null or repeat;
    other columns are ignored; an empty table gives no row.
    """
    packed = pack(docs)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, payload, answers in zip(frame["batch"], frame["payload"], frame["answers"]):
                batch = Batch(number, payload)
                gone = _covered(batch, answers, length)
                rows = []
                for i, doc_id in enumerate(batch.ids.to_pylist()):
                    a, b = batch.offsets[i], batch.offsets[i + 1]
                    mask = gone[a:b]
                    rest = batch.buf[a:b][~mask].tobytes()
                    rows.append((doc_id, int(b - a), int(mask.sum()), len(runs(mask)[0]), hashlib.sha256(rest).hexdigest()))
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    joined = packed.join(repeated_places(packed, length, **options), "batch", "left").select("batch", "payload", "answers")
    return joined.mapInPandas(apply, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def strip_repeats(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """The rows of ``docs``, all columns, with the whole characters of repeated strings taken out of ``text``.

    ``n_chars``, if there, follows.  A null text stays null.
    """
    schema = docs.schema
    packed = pack(docs, carry=True)

    def apply(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for number, payload, answers in zip(*(frame.column(k).to_pylist() for k in range(3))):
                batch = Batch(number, payload)
                gone = _covered(batch, answers, length)
                # A character goes if all its bytes do.
                head = (batch.buf & 0xC0) != 0x80
                head[batch.offsets[:-1][batch.offsets[:-1] < len(head)]] = True
                char = np.cumsum(head) - 1
                gone = np.logical_and.reduceat(gone, np.flatnonzero(head))[char] if len(head) else gone
                nulls = batch.nulls
                texts = [
                    None if nulls[i] else batch.buf[batch.offsets[i] : batch.offsets[i + 1]][~gone[batch.offsets[i] : batch.offsets[i + 1]]].tobytes().decode("utf-8", "replace")
                    for i in range(batch.rows)
                ]
                rows = documents_of(batch, names, pa.array(texts, pa.string()))
                if "n_chars" in names:
                    old = rows["n_chars"]
                    fresh = pa.array([o if t is None else len(t) for o, t in zip(old.to_pylist(), texts)], old.type)
                    rows = rows.set_column(names.index("n_chars"), "n_chars", fresh)
                yield from rows.to_batches()

    names = [f.name for f in schema.fields]
    joined = packed.join(repeated_places(packed, length, **options), "batch", "left").select("batch", "payload", "answers")
    return joined.mapInArrow(apply, schema)
