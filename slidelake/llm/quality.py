"""Quality rules: base counts and a calibrated classifier against fixed thresholds.

The classifier is a logistic regression on hashed word and character n-grams,
fitted on a bounded sample of labelled rows and calibrated on the part of the
sample that it has not seen.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidelake.llm.learn import Adam, labelled_sample, map_texts, pieces, sigmoid
from slidelake.llm.textops import hash_runs, hash_spans, mix, spread, words

#: Fit on at most this many documents of either label.
PER_CLASS = 1500
BITS = 17
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
THRESHOLD = 0.5
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_CHARS = 4  # bytes of a character n-gram
_KINDS = 3  # words, word pairs, character n-grams


def repeated(keys: np.ndarray, earlier_only: bool) -> np.ndarray:
    """Which entries equal another one (or an earlier one) of the list."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    flag = np.zeros(len(keys), bool)
    flag[order[1:]] = same
    if not earlier_only:
        flag[order[:-1]] |= same
    return flag


def base_counts(buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The five base counts of every text of a slice."""
    n = len(offsets) - 1
    starts, ends, doc = words(buf, offsets)
    count = np.bincount(doc, minlength=n)
    # A code point has one byte that is no continuation byte; blanks are single bytes.
    points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    marks = np.concatenate(([0], np.cumsum(_SYMBOL[buf])))
    letters = np.zeros(n, np.int64)
    np.add.at(letters, doc, points[ends] - points[starts])

    # A line begins at each document and after each newline; it ends before the next line or at its newline.
    breaks = np.flatnonzero(buf == 10)
    line_starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    line_doc = np.sort(np.concatenate((np.arange(n), np.searchsorted(offsets, breaks, "right") - 1)))
    line_ends = np.append(line_starts[1:], len(buf))
    line_ends = line_ends - (np.append(line_doc[1:], n) == line_doc)
    lines = np.flatnonzero(np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts))
    key = mix(hash_spans(buf, line_starts[lines], line_ends[lines]) + line_doc[lines].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    twice = np.bincount(line_doc[lines][repeated(key, True)], minlength=n)

    covered = np.zeros(n, np.int64)
    if len(starts) >= 3:
        whole = np.flatnonzero(doc[2:] == doc[:-2])
        runs = hash_runs(hash_spans(buf, starts, ends), 3)[whole]
        again = repeated(mix(runs + doc[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), False)
        mask = np.zeros(len(starts), bool)
        mask[whole[again]] = True
        covered = np.bincount(doc[spread(mask, 3, len(starts))], minlength=n)
    return {
        "n_words": count.astype(np.int64), "word_chars": letters, "n_symbols": marks[offsets[1:]] - marks[offsets[:-1]],
        "n_dup_lines": twice.astype(np.int64), "n_repeat_words": covered.astype(np.int64),
    }


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed feature numbers, their documents and the share each adds to its document."""
    n = len(offsets) - 1
    starts, ends, doc = words(buf, offsets)
    size = np.uint64(1 << BITS)
    single = hash_spans(buf, starts, ends)
    whole = np.flatnonzero(doc[1:] == doc[:-1])
    pairs = hash_runs(single, 2)[whole]
    grams, gram_doc = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(buf) >= _CHARS:
        at = np.arange(len(buf) - _CHARS + 1)
        owner = np.repeat(np.arange(n), np.diff(offsets))
        keep = at[owner[: len(at)] == owner[_CHARS - 1 :]]
        four = np.ndarray((len(at),), "<u4", np.ascontiguousarray(buf), strides=(1,))
        grams, gram_doc = mix(four[keep].astype(np.uint64)), owner[keep]
    parts = [(single, doc), (pairs, doc[whole]), (grams, gram_doc)]
    ids, docs, shares = [], [], []
    for kind, (hashes, of) in enumerate(parts):
        ids.append((hashes % size).astype(np.int64) + (kind << BITS))
        docs.append(of)
        shares.append((8.0 / np.maximum(np.bincount(of, minlength=n), 1))[of])
    return np.concatenate(ids), np.concatenate(docs), np.concatenate(shares)


class Model:
    def __init__(self, weights: np.ndarray, slope: float, shift: float):
        self.weights, self.slope, self.shift = weights, slope, shift

    def raw(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        ids, docs, shares = features(buf, offsets)
        return np.bincount(docs, self.weights[ids] * shares, len(offsets) - 1) + self.weights[-1]

    def probability(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.raw(buf, offsets) + self.shift)


def fit(table: pa.Table, rounds: int = 120) -> Model:
    """Logistic regression and calibration from ``text``, ``quality`` and ``_weight``; without both labels, all pass."""
    y = np.asarray(table["quality"].to_numpy(), float) if table.num_rows else np.zeros(0)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros((_KINDS << BITS) + 1), 0.0, 30.0 if not len(y) or y.max() else -30.0)
    parts = []
    for buf, offsets, begin in pieces(table):
        ids, docs, shares = features(buf, offsets)
        # Equal features of a document add up once.
        key, where = np.unique(docs * np.int64(_KINDS << BITS) + ids, return_inverse=True)
        value = np.bincount(where, shares).astype(np.float32)
        parts.append(((key // (_KINDS << BITS) + begin).astype(np.int32), (key % (_KINDS << BITS)).astype(np.int32), value))
    docs, ids, value = (np.concatenate(x) for x in zip(*parts))
    del parts
    weight = table["_weight"].to_numpy()
    held = np.arange(len(y)) % 5 == 0
    seen = ~held[docs]
    docs_fit, ids_fit, value_fit = docs[seen], ids[seen], value[seen]
    fit_weight = np.where(held, 0.0, weight)
    fit_weight /= fit_weight.sum()
    w = np.zeros((_KINDS << BITS) + 1)
    adam = Adam(len(w), 0.05)
    for _ in range(rounds):
        z = np.bincount(docs_fit, w[ids_fit] * value_fit, len(y)) + w[-1]
        slope = (sigmoid(z) - y) * fit_weight
        grad = np.bincount(ids_fit, slope[docs_fit] * value_fit, len(w)) + 1e-5 * w
        grad[-1] = slope.sum()
        adam.step(w, grad)
    raw = np.bincount(docs, w[ids] * value, len(y)) + w[-1]
    slope, shift = calibrate(raw[held], y[held], weight[held])
    return Model(w, slope, shift)


def calibrate(raw: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 500) -> tuple[float, float]:
    """Slope and shift of a logistic curve through held-out scores, with smoothed targets."""
    good, bad = weight[y > 0].sum(), weight[y == 0].sum()
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    p = np.array([1.0, 0.0])
    adam = Adam(2, 0.05)
    for _ in range(rounds):
        off = (sigmoid(p[0] * raw + p[1]) - target) * weight / weight.sum()
        adam.step(p, np.array([(off * raw).sum(), off.sum()]))
    return float(p[0]), float(p[1])


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, per_class: int = PER_CLASS) -> Model:
    return fit(labelled_sample(docs, labels, "quality", F.lit(True) if usable is None else usable, per_class))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Base counts, ``base_failed``, ``quality`` (probability) and ``kept`` of every row of ``docs(doc_id, text)``.

    Null and empty texts have no words and fail the base rules; repeated rows
    score alike; other columns are ignored; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.slope, model.shift))

    def run(known: Model, buf: np.ndarray, offsets: np.ndarray) -> dict:
        return base_counts(buf, offsets) | {"quality": known.probability(buf, offsets)}

    def make():
        return partial(run, Model(*shared.value))

    counts = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
    found = map_texts(docs, make, f"{counts}, quality double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= threshold))


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels and judge all documents."""
    return score(docs, train(docs, labels))
