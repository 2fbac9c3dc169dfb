"""Removing repeated windows of words by super-k-mer partitioning.

Consecutive windows that share a minimiser travel as one packed string of words
to the minimiser's bucket; there all windows are sorted, equal ones stand side
by side, and the earliest stays.  A batch of documents settles its own repeats
first, so a window that is everywhere reaches its bucket once per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.llm.batches import Batch, each_batch, pack, release_memory, shuffle_width
from slidelake.llm.textops import hash_runs, hash_spans, mix, spread, window_min, words

WINDOW = 20
#: Words of a minimiser; a window has WINDOW - GRAM + 1 of them.
GRAM = 4
#: Buckets for each shuffle partition, so that partitions fill evenly.
BUCKETS_EACH = 4
#: Packed strings travel to other machines, so they are worth compressing well.
LEVEL = 7
NO_ID = np.iinfo(np.int64).max  # a null id comes last


def first_of_equal(
    buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, order: tuple[np.ndarray, ...], width: int, hashes: np.ndarray
) -> np.ndarray:
    """Marks the windows that equal an earlier one.

    Window i covers the ``width`` words from ``at[i]``; ``order`` ranks windows,
    most significant key first.  Windows are sorted by hash; only those that share it
    are hashed a second time, with other constants, and sorted by both hashes and their rank.
    """
    late = np.zeros(len(at), bool)
    own = hashes[at]
    rank = np.argsort(own)
    same = own[rank[1:]] == own[rank[:-1]]
    if not same.any():
        return late
    met = rank[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    covered = np.zeros(len(starts), bool)
    covered[at[met]] = True
    covered = spread(covered, width, len(starts))
    check = np.zeros(len(starts), np.uint64)
    check[covered] = hash_spans(buf, starts[covered], ends[covered], 1)
    own, second = own[met], hash_runs(check, width, 1)[at[met]]
    rank = np.lexsort((*(key[met] for key in reversed(order)), second, own))
    own, second = own[rank], second[rank]
    new = np.concatenate(([True], (own[1:] != own[:-1]) | (second[1:] != second[:-1])))
    head = np.maximum.accumulate(np.where(new, np.arange(len(met)), 0))
    # A row standing at the place of its first copy is that copy (a repeated row).
    differs = np.zeros(len(met), bool)
    for key in order:
        values = key[met[rank]]
        differs |= values != values[head]
    late[met[rank]] = differs
    return late


class Windows:
    """Word positions, window hashes and minimisers of one batch."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, window: int, gram: int):
        self.starts, self.ends, self.doc = words(buf, offsets)
        n = len(self.starts)
        single = hash_spans(buf, self.starts, self.ends)
        self.hashes = hash_runs(single, window)
        whole = self.doc[window - 1 :] == self.doc[: n - window + 1] if n >= window else np.zeros(0, bool)
        self.at = np.flatnonzero(whole)
        self.least = window_min(hash_runs(single, gram), window - gram + 1) if n >= window else self.hashes
        count = np.bincount(self.doc, minlength=len(offsets) - 1)
        self.first = np.concatenate(([0], np.cumsum(count)))
        self.place = self.at - self.first[self.doc[self.at]]


def _order_ids(batch: Batch) -> np.ndarray:
    return batch.ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)


def _text_keys(batch: Batch) -> np.ndarray:
    """Sixteen bits that tell texts of one id apart, so that only repeated rows count as one document."""
    return (hash_spans(batch.buf, batch.offsets[:-1], batch.offsets[1:]) >> np.uint64(48)).astype(np.int64)


def _pack(**arrays: np.ndarray) -> bytes:
    table = pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.large_binary()) for v in arrays.values()], list(arrays))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_batch(table)
    return zstandard.ZstdCompressor(level=LEVEL).compress(sink.getvalue().to_pybytes())


def _unpack(data: bytes) -> dict[str, bytes]:
    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()
    return {name: table[name][0].as_py() for name in table.column_names}


def ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The integers of all ranges side by side."""
    total = np.concatenate(([0], np.cumsum(length)))
    return np.arange(total[-1]) - np.repeat(total[:-1] - begin, length)


def _send(batch: Batch, window: int, gram: int, buckets: int) -> list[tuple[int, int, bytes]]:
    """Packed super-k-mers of the windows that are first in their batch, by bucket."""
    w = Windows(batch.buf, batch.offsets, window, gram)
    if not len(w.at):
        return []
    ids, keys = _order_ids(batch), _text_keys(batch)
    of = w.doc[w.at]
    late = first_of_equal(batch.buf, w.starts, w.ends, w.at, (ids[of], keys[of], w.place), window, w.hashes)
    kept = np.flatnonzero(~late)
    at = w.at[kept]
    least = w.least[at]
    # A string goes on while windows are consecutive and share the minimiser.
    new = np.concatenate(([True], (np.diff(at) != 1) | (least[1:] != least[:-1]) | (w.doc[at[1:]] != w.doc[at[:-1]])))
    head = np.flatnonzero(new)
    begin = at[head]
    count = np.diff(np.append(head, len(at)))
    bucket = (mix(least[head]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    out = []
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:]):
        s = order[a:b]
        word_count = count[s] + window - 1
        picked = ranges(begin[s], word_count)
        size = w.ends[picked] - w.starts[picked] + 1
        # Each word and the byte after it; the text's end gets a blank of its own.
        source = ranges(w.starts[picked], size)
        text = np.where(source < len(batch.buf), batch.buf[np.minimum(source, len(batch.buf) - 1)], 32).astype(np.uint8)
        text[np.cumsum(size) - 1] = 32
        doc = w.doc[begin[s]]
        payload = _pack(
            text=text, windows=count[s].astype(np.int32), index=doc.astype(np.int32), ids=ids[doc], keys=keys[doc].astype(np.uint16),
            place=(begin[s] - w.first[doc]).astype(np.int32),
        )
        out.append((batch.number, int(bucket[s[0]]), payload))
    return out


def _settle(group: pd.DataFrame, window: int) -> list[tuple[int, bytes]]:
    """Sort all windows of a bucket; answer each batch with its windows that come later than an equal one."""
    parts = [_unpack(p) for p in group["payload"]]
    number = np.repeat(np.arange(len(parts)), [len(p["windows"]) // 4 for p in parts])
    read = lambda name, kind: np.frombuffer(b"".join(p[name] for p in parts), kind)
    buf, count, index = read("text", np.uint8), read("windows", np.int32).astype(np.int64), read("index", np.int32)
    ids, keys, place = read("ids", np.int64), read("keys", np.uint16).astype(np.int64), read("place", np.int32).astype(np.int64)
    starts, ends, _ = words(buf, np.array([0, len(buf)]))
    hashes = hash_runs(hash_spans(buf, starts, ends), window)
    first = np.concatenate(([0], np.cumsum(count + window - 1)[:-1]))
    at = ranges(first, count)
    owner = np.repeat(np.arange(len(count)), count)
    where = place[owner] + at - first[owner]
    late = np.flatnonzero(first_of_equal(buf, starts, ends, at, (ids[owner], keys[owner], where), window, hashes))
    out = []
    batches = group["batch"].to_numpy()
    of = number[owner[late]]
    for k in np.unique(of):
        mine = late[of == k]
        out.append((int(batches[k]), _pack(index=index[owner[mine]], place=where[mine])))
    return out


def repeated_windows(packed: DataFrame, window: int = WINDOW, gram: int = GRAM, buckets: int | None = None) -> DataFrame:
    """``(batch, payload)``: windows of packed documents that an earlier equal window of another batch precedes.

    ``buckets`` bounds what a task sorts at once; give it in proportion to the
    corpus (a bucket should hold some 100 MB at most).
    """
    buckets = buckets or BUCKETS_EACH * shuffle_width(packed)

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in each_batch(frames):
            yield pd.DataFrame(_send(batch, window, gram, buckets), columns=["batch", "bucket", "payload"])

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        found = pd.DataFrame(_settle(group, window), columns=["batch", "payload"])
        release_memory()
        return found

    sent = packed.mapInPandas(send, "batch bigint, bucket bigint, payload binary")
    return sent.groupBy("bucket").applyInPandas(settle, "batch bigint, payload binary")


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, buckets: int | None = None, with_text: bool = False
) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every row of ``docs(doc_id, text)``.

    A word goes when it lies in a window that also starts earlier (smaller id, or
    earlier in the same text).  Null texts have no words; a null id comes after
    all others; of different texts with one id a fixed one is first; repeated
    rows (same id and text) are one document and get the same answer; other
    columns are ignored; an empty table gives no row.  ``with_text``
    adds ``kept``, the rest of the words joined by blanks.
    """
    packed = pack(docs)
    answers = repeated_windows(packed, window, gram, buckets).groupBy("batch").agg(F.collect_list("payload").alias("answers"))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])]

    def apply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, payload, replies in zip(frame["batch"], frame["payload"], frame["answers"]):
                rows = [r[: len(names)] for r in _apply(Batch(number, payload), replies, window, gram)]
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                release_memory()

    # Answers of a batch number its windows at most.
    return packed.join(answers, "batch", "left").select("batch", "payload", "answers").mapInPandas(
        apply, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + ", kept binary" * with_text
    )


def _apply(batch: Batch, replies, window: int, gram: int) -> list[tuple]:
    w = Windows(batch.buf, batch.offsets, window, gram)
    ids, keys = _order_ids(batch), _text_keys(batch)
    marked = np.zeros(len(w.starts), bool)
    if len(w.at):
        of = w.doc[w.at]
        late = first_of_equal(batch.buf, w.starts, w.ends, w.at, (ids[of], keys[of], w.place), window, w.hashes)
        marked[w.at[late]] = True
    told = [_unpack(r) for r in replies] if replies is not None else []
    index = np.concatenate([np.frombuffer(t["index"], np.int32) for t in told] or [np.zeros(0, np.int32)]).astype(np.int64)
    place = np.concatenate([np.frombuffer(t["place"], np.int64) for t in told] or [np.zeros(0, np.int64)])
    marked[w.first[index] + place] = True
    if len(index):
        # Only the first of some repeated rows was sent.
        _, same = np.unique(np.stack((ids, keys)), axis=1, return_inverse=True)
        same = same.ravel()
        twins = np.bincount(same) > 1
        for i in np.unique(index[twins[same[index]]]):
            span = marked[w.first[i] : w.first[i + 1]]
            for j in np.flatnonzero(same == same[i]):
                marked[w.first[j] : w.first[j + 1]] |= span
    gone = spread(marked, window, len(marked))
    out = []
    for i, doc_id in enumerate(batch.ids.to_pylist()):
        a, b = w.first[i], w.first[i + 1]
        text = batch.text(i)
        if gone[a:b].any():
            base = batch.offsets[i]
            text = b" ".join(text[s - base : e - base] for s, e, g in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist(), gone[a:b].tolist()) if not g)
        else:
            text = b" ".join(text.split())
        out.append((doc_id, int(b - a), int(gone[a:b].sum()), hashlib.sha256(text).hexdigest(), text))
    return out
