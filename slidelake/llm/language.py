"""Language identification of mixed-language text.

Every word is scored for the languages whose training text uses its script.
Viterbi decoding with a penalty for switching then labels each word, which gives
spans; the language with most letters names the document.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidelake.llm.learn import MAX_FIT_BYTES, fold, map_texts, pieces, sample_by_class
from slidelake.llm.textops import LOWER, hash_spans, mix, words

PER_LANGUAGE = 1500
#: All languages together; with many languages each gets fewer.
MAX_FIT_DOCS = 12_000
FOLDS, HELD_OUT = 4, 2
BITS = 16
SWITCH_PENALTY = 6.0
#: A language is a candidate for a script that holds this share of its words.
MIN_SCRIPT_SHARE = 0.01
_NOT_CANDIDATE = -1e3
_ORDERS = (1, 2, 3, 4)  # bytes of a word's n-grams, blanks around it included

# First and last code point of the scripts told apart.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
_RANGES = sorted((low, high, i + 1) for i, ranges in enumerate(SCRIPTS.values()) for low, high in ranges)
_LOW, _HIGH, _SCRIPT = (np.array(x) for x in zip(*_RANGES))

# Letters, and all bytes of characters outside ASCII, belong to words.
_BREAK = np.zeros(256, bool)
_BREAK[:128] = True
_BREAK[65:91] = _BREAK[97:123] = False


def first_script(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Script number of the first character of each word; 0 for any other."""
    padded = np.concatenate((buf, np.zeros(4, np.uint8))).astype(np.int64)
    b0, b1, b2, b3 = (padded[starts + k] for k in range(4))
    point = np.where(b0 < 0x80, b0, (b0 & 0x1F) << 6 | b1 & 0x3F)
    point = np.where(b0 >= 0xE0, (b0 & 0x0F) << 12 | (b1 & 0x3F) << 6 | b2 & 0x3F, point)
    point = np.where(b0 >= 0xF0, (b0 & 0x07) << 18 | (b1 & 0x3F) << 12 | (b2 & 0x3F) << 6 | b3 & 0x3F, point)
    at = np.maximum(np.searchsorted(_LOW, point, "right") - 1, 0)
    return np.where((point >= _LOW[at]) & (point <= _HIGH[at]), _SCRIPT[at], 0)


def word_grams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram numbers of each distinct word, and the word each belongs to."""
    # Words side by side with a blank before and after each.
    lengths = ends - starts + 2
    to = np.concatenate(([0], np.cumsum(lengths)))
    flat = np.full(to[-1] + 8, 32, np.uint8)
    owner = np.repeat(np.arange(len(starts)), lengths)
    place = np.arange(to[-1]) - to[owner]
    inner = (place > 0) & (place < lengths[owner] - 1)
    flat[: to[-1]][inner] = buf[(starts[owner] + place - 1)[inner]]
    eight = np.ndarray((to[-1],), "<u8", flat, strides=(1,))
    ids, of = [], []
    for k in _ORDERS:
        fits = place + k <= lengths[owner]
        code = eight[fits] & np.uint64((1 << 8 * k) - 1)
        ids.append((mix(code + np.uint64(k << 56)) >> np.uint64(64 - BITS)).astype(np.int64) + (k - 1 << BITS))
        of.append(owner[fits])
    return np.concatenate(ids), np.concatenate(of)


class Texts:
    """Words of a slice, with their distinct forms."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        low = LOWER[buf]
        self.starts, self.ends, self.doc = words(low, offsets, _BREAK)
        _, first, self.form = np.unique(hash_spans(low, self.starts, self.ends), return_index=True, return_inverse=True)
        self.ids, self.of = word_grams(low, self.starts[first], self.ends[first])
        self.forms = len(first)
        self.script = first_script(low, self.starts[first])


class Model:
    """Log probabilities of n-grams by language and the scripts of each language."""

    def __init__(self, languages: list[str], table: np.ndarray, candidate: np.ndarray):
        self.languages, self.table, self.candidate = languages, table, candidate

    def scores(self, t: Texts) -> np.ndarray:
        """Mean n-gram score of each distinct word and language, up to a constant per word."""
        out = np.empty((t.forms, len(self.languages)))
        size = np.maximum(np.bincount(t.of, minlength=t.forms), 1)
        for j in range(len(self.languages)):
            out[:, j] = np.bincount(t.of, self.table[:, j][t.ids], t.forms) / size
        allowed = self.candidate[t.script]
        return np.where(allowed | ~allowed.any(axis=1, keepdims=True), out * 2.0, _NOT_CANDIDATE)


def viterbi(scores: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word; texts advance side by side, a switch costs ``penalty``.

    Keeping a label wins a tie, then the lower label.
    """
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    label = np.zeros(len(scores), np.int64)
    if not len(scores):
        return label
    longest = int(count[0])
    alive = np.searchsorted(-count, -np.arange(longest), "left")  # texts with more than t words
    value = scores[first[: alive[0]]].copy()
    stay = np.zeros(scores.shape, bool)
    best = np.zeros(len(scores), np.int32)  # by word: best label of the word before
    for t in range(1, longest):
        n = alive[t]
        at = first[:n] + t
        before = value[:n]
        top = before.argmax(axis=1)
        moved = before[np.arange(n), top][:, None] - penalty
        stay[at] = before >= moved
        best[at] = top
        value[:n] = np.maximum(before, moved) + scores[at]
    now = np.zeros(alive[0], np.int64)
    for t in range(longest - 1, -1, -1):
        n = alive[t]
        at = first[:n] + t
        ending = count[:n] == t + 1
        now[:n][ending] = value[:n][ending].argmax(axis=1)
        label[at] = now[:n]
        if t:
            now[:n] = np.where(stay[at, now[:n]], now[:n], best[at])
    return label


def fit(table: pa.Table, label: str = "lang") -> Model:
    """Smoothed n-gram statistics of ``text`` by ``label``."""
    names = sorted(set(table[label].to_pylist()))
    number = {x: i for i, x in enumerate(names)}
    of_doc = np.array([number[x] for x in table[label].to_pylist()], np.int64)
    counts = np.zeros((len(_ORDERS) << BITS, len(names)))
    shares = np.zeros((len(SCRIPTS) + 1, len(names)))
    for buf, offsets, begin in pieces(table):
        t = Texts(buf, offsets)
        speech = of_doc[t.doc + begin]
        for j in np.unique(speech):
            uses = np.bincount(t.form[speech == j], minlength=t.forms)
            counts[:, j] += np.bincount(t.ids, uses[t.of], len(counts))
            shares[:, j] += np.bincount(t.script, uses, len(shares))
    shares /= np.maximum(shares.sum(axis=0), 1)
    log = np.empty(counts.shape, np.float32)
    for k in range(len(_ORDERS)):
        part = counts[k << BITS : k + 1 << BITS]
        log[k << BITS : k + 1 << BITS] = np.log((part + 0.5) / (part.sum(axis=0) + 0.5 * len(part)))
    return Model(names, log, shares >= MIN_SCRIPT_SHARE)


def train(docs: DataFrame, usable: Column | None = None, label: str = "lang") -> Model:
    """Fit on a bounded sample of each language; ``usable`` is a condition on ``doc_id``."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col(label).cast("string").alias(label)).filter(
        F.col("doc_id").isNotNull() & F.col(label).isNotNull() & F.col("text").isNotNull()
        & (F.octet_length("text") <= MAX_FIT_BYTES) & (F.lit(True) if usable is None else usable)
    )
    found = sample_by_class(rows, label, PER_LANGUAGE, MAX_FIT_DOCS).limit(2 * MAX_FIT_DOCS)
    return fit(found.select("doc_id", "text", label).orderBy("doc_id", "text").select("text", label).toArrow(), label)


def identify(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``(doc_id, lang_pred, score, spans)`` of every row of ``docs(doc_id, text)``.

    ``score`` is the share of letters in spans of the named language; ``spans``
    lists byte ranges and languages.  Texts that are null or without a letter are
    ``und`` with score 0, as is everything when no language was learned; equal
    shares go to the first language by name; repeated rows get equal results;
    other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table, model.candidate))

    def run(known: Model, buf: np.ndarray, offsets: np.ndarray) -> dict:
        n, names = len(offsets) - 1, known.languages
        t = Texts(buf, offsets)
        count = np.bincount(t.doc, minlength=n)
        first = np.concatenate(([0], np.cumsum(count)[:-1])) if n else count
        if not names:
            t.form = t.form[:0]
        scores = known.scores(t)[t.form] if names else np.zeros((0, 1))
        label = viterbi(scores, first, count, penalty) if names else np.zeros(0, np.int64)
        # Characters, so that accented letters do not count twice.
        points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
        size = points[t.ends] - points[t.starts]
        letters = np.zeros((n, max(1, len(names))))
        if names:
            np.add.at(letters, (t.doc, label), size)
        top, total = letters.argmax(axis=1), letters.sum(axis=1)
        plain = np.concatenate(([0], np.cumsum(~_BREAK[buf] & (buf < 128))))
        clear = plain[offsets[1:]] > plain[offsets[:-1]]
        for i in np.flatnonzero(~clear & (total > 0)):  # only characters outside ASCII: are any letters?
            clear[i] = any(c.isalpha() for c in buf[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
        clear &= total > 0
        # A span is a run of words of one text and label.
        if names and len(label):
            new = np.flatnonzero(np.concatenate(([True], (label[1:] != label[:-1]) | (t.doc[1:] != t.doc[:-1]))))
        else:
            new = np.zeros(0, np.int64)
        new = new[clear[t.doc[new]]]
        close = np.append(new[1:], len(t.doc))
        last = np.minimum(close, np.concatenate(([0], np.cumsum(count)))[t.doc[new] + 1]) - 1
        base = offsets[t.doc[new]]
        spans = pa.StructArray.from_arrays(
            [
                pa.array(t.starts[new] - base, pa.int64()), pa.array(t.ends[last] - base, pa.int64()),
                pa.array([names[i] for i in label[new]], pa.string()),
            ],
            ["begin", "end", "lang"],
        )
        where = np.concatenate(([0], np.cumsum(np.bincount(t.doc[new], minlength=n)))).astype(np.int32)
        return {
            "lang_pred": pa.array([names[i] if ok else "und" for i, ok in zip(top, clear)], pa.string()),
            "score": np.where(clear, letters[np.arange(n), top] / np.maximum(total, 1), 0.0),
            "spans": pa.ListArray.from_arrays(pa.array(where), spans),
        }

    def make():
        return partial(run, Model(*shared.value))

    return map_texts(
        docs, make, "lang_pred string, score double, spans array<struct<begin: bigint, end: bigint, lang: string>>", 4 << 20
    )


def detect(docs: DataFrame) -> DataFrame:
    """Label all documents with a model that has not seen the held-out fold.

    A null ``doc_id`` counts as held out, since nothing is learned from it.
    """
    model = train(docs, fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    return identify(docs, model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(True)).alias("held_out"), "lang_pred", "score", "spans"
    )
