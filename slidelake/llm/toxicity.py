"""Toxicity by multiple-instance learning.

A document is a bag of sentences.  Every sentence gets a probability from its
words and word pairs, and a document is toxic unless none of its sentences is
(noisy-or).  Weights are learned from document labels only; the sentence
probabilities then tell which sentences offend.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slidelake.llm.batches import bytes_of, release_memory
from slidelake.llm.learn import Adam, Vocabulary, fold, labelled_sample, map_texts, pieces, sigmoid
from slidelake.llm.textops import LOWER, SPACE, hash_runs, hash_spans, splits, words

#: Fit on at most this many documents of either label.
PER_CLASS = 2000
MIN_DOCS = 5
#: Weight decay; it keeps words of a few documents from standing in for what many share.
PENALTY = 1e-4
FOLDS = 5
SENTENCE_WORDS = 40
#: Bytes of a word's beginning and ending that count as features.
AFFIXES = (4, 5, 6)
_HEAD, _TAIL = np.uint64(0x5BD1E995), np.uint64(0xC2B2AE35)
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True  # newline ! . ?
# Everything in ASCII but letters, digits and the apostrophe parts words.
_BREAK = SPACE.copy()
_BREAK[:128] = True
for _low, _high in ((48, 58), (65, 91), (97, 123), (39, 40)):
    _BREAK[_low:_high] = False


class Sentences:
    """Words, features and sentence numbers of a slice of texts."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        buf = LOWER[buf]
        self.starts, self.ends, self.doc = words(buf, offsets, _BREAK)
        n = len(self.starts)
        stops = np.concatenate(([0], np.cumsum(_STOP[buf])))
        ended = np.ones(n, bool)  # a sentence begins here
        if n:
            ended[1:] = (stops[self.starts[1:]] > stops[self.ends[:-1]]) | (self.doc[1:] != self.doc[:-1])
        first = np.flatnonzero(ended)
        # Cut what has no full stop, so that a sentence stays a small place.
        inside = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        ended |= inside % SENTENCE_WORDS == 0
        self.first = np.flatnonzero(ended)
        self.sentence = np.cumsum(ended) - 1
        self.count = len(self.first)
        self.sentence_doc = self.doc[self.first]
        single = hash_spans(buf, self.starts, self.ends)
        whole = np.flatnonzero(self.sentence[1:] == self.sentence[:-1])
        features, owner = [single, hash_runs(single, 2)[whole]], [self.sentence, self.sentence[whole]]
        # Beginnings and endings carry inflected and compound forms.
        for k in AFFIXES:
            long = np.flatnonzero(self.ends - self.starts > k)
            features += [
                hash_spans(buf, self.starts[long], self.starts[long] + k) ^ _HEAD,
                hash_spans(buf, self.ends[long] - k, self.ends[long]) ^ _TAIL,
            ]
            owner += [self.sentence[long]] * 2
        self.features, self.owner = np.concatenate(features), np.concatenate(owner)


def noisy_or(p: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    return -np.expm1(np.bincount(group, np.log1p(-np.minimum(p, 1 - 1e-12)), groups))


class Model:
    """Sentence weights, bias and the features they belong to."""

    def __init__(self, known: Vocabulary, weights: np.ndarray, bias: float):
        self.known, self.weights, self.bias = known, weights, bias

    def sentences(self, s: Sentences) -> np.ndarray:
        return sigmoid(np.bincount(s.owner, self.weights[self.known.of(s.features)], s.count) + self.bias)


def fit(table: pa.Table, label: str = "toxic", rounds: int = 250) -> Model:
    """Learn from ``text``, ``label`` and ``_weight``; without either label, nothing is toxic."""
    y = np.asarray(table[label].to_numpy(), float) if table.num_rows else np.zeros(0)
    if not len(y) or y.max() == 0:
        return Model(Vocabulary(np.zeros(0, np.uint64)), np.zeros(1), -30.0)
    weight = table["_weight"].to_numpy()
    weight = weight / weight.sum()
    # First the features of enough documents, then their places.
    distinct = []
    for buf, offsets, _ in pieces(table):
        s = Sentences(buf, offsets)
        of = s.sentence_doc[s.owner]
        order = np.lexsort((of, s.features))
        new = np.concatenate(([True], (np.diff(s.features[order]) != 0) | (np.diff(of[order]) != 0))) if len(order) else order > 0
        distinct.append(np.unique(s.features[order][new], return_counts=True))
    keys, at = np.unique(np.concatenate([k for k, _ in distinct]), return_inverse=True)
    known = Vocabulary(keys[np.bincount(at, np.concatenate([n for _, n in distinct])) >= MIN_DOCS])
    del distinct, at, keys
    places, owners, docs, sentences = [], [], [], 0
    for buf, offsets, begin in pieces(table):
        s = Sentences(buf, offsets)
        found = known.of(s.features)
        used = found < known.size
        places.append(found[used].astype(np.int32))
        owners.append((s.owner[used] + sentences).astype(np.int32))
        docs.append(s.sentence_doc + begin)
        sentences += s.count
    at, owner, sentence_doc = np.concatenate(places), np.concatenate(owners), np.concatenate(docs)
    del places, owners, docs
    w = np.zeros(known.size + 2)  # last: bias; before it: unknown features, which stay 0
    w[-1] = -5.0
    adam = Adam(len(w), 0.1)
    for _ in range(rounds):
        p = sigmoid(np.bincount(owner, w[at], sentences) + w[-1])
        whole = np.clip(noisy_or(p, sentence_doc, len(y)), 1e-9, 1 - 1e-12)
        # Slope of the log likelihood by a sentence's logit.
        slope = np.where(y > 0, (1 - whole) / whole, -1.0)[sentence_doc] * p * weight[sentence_doc]
        grad = -np.bincount(at, slope[owner], len(w))
        grad[-1] = -slope.sum()
        grad[:-1] += PENALTY * w[:-1]
        adam.step(w, grad)
        w[-2] = 0.0
    return Model(known, w[:-1], float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    """Fit on a bounded sample of labelled rows; ``usable`` is a condition on ``doc_id``."""
    usable = F.lit(True) if usable is None else usable
    return fit(labelled_sample(docs, labels, label, usable, per_class), label)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, sentences)`` of every row of ``docs(doc_id, text)``.

    ``sentences`` lists byte ranges and probabilities of those at 0.5 or more.
    Null and empty texts score 0; repeated rows score alike; other columns are
    ignored; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.known.keys, model.weights, model.bias))

    def run(model: Model, buf: np.ndarray, offsets: np.ndarray) -> dict:
        s = Sentences(buf, offsets)
        p = model.sentences(s)
        n = len(offsets) - 1
        bad = np.flatnonzero(p >= 0.5)
        last = np.append(s.first[1:], len(s.starts))[bad] - 1 if len(bad) else bad
        base = offsets[s.sentence_doc[bad]] if len(bad) else bad
        spans = pa.StructArray.from_arrays(
            [pa.array((s.starts[s.first[bad]] if len(bad) else bad) - base, pa.int64()), pa.array((s.ends[last] if len(bad) else bad) - base, pa.int64()), pa.array(p[bad], pa.float64())],
            ["begin", "end", "score"],
        )
        each = np.bincount(s.sentence_doc[bad], minlength=n) if len(bad) else np.zeros(n, np.int64)
        where = np.concatenate(([0], np.cumsum(each))).astype(np.int32)
        return {"score": noisy_or(p, s.sentence_doc, n), "sentences": pa.ListArray.from_arrays(pa.array(where), spans)}

    def make():
        keys, weights, bias = shared.value
        return partial(run, Model(Vocabulary(keys), weights, bias))

    return map_texts(docs, make, "score double, sentences array<struct<begin: bigint, end: bigint, score: double>>")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast((model.known.keys, model.weights, model.bias))
    at = docs.columns.index("text")

    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, weights, bias = shared.value
        known = Model(Vocabulary(keys), weights, bias)
        for piece in arrow:
            buf, offsets = bytes_of(piece.column(at))
            for begin, end in splits(np.diff(offsets), 1 << 20):
                part = offsets[begin : end + 1]
                s = Sentences(buf[part[0] : part[-1]], part - part[0])
                whole = noisy_or(known.sentences(s), s.sentence_doc, end - begin)
                yield piece.slice(begin, end - begin).filter(pa.array(whole < threshold))
            release_memory()

    return docs.mapInArrow(run, docs.schema)


def detect(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score all documents with a model that has not seen the held-out fold.

    A null ``doc_id`` counts as held out, since nothing is learned from it.
    """
    model = train(docs, labels, fold(F.col("doc_id"), FOLDS) != 0)
    return score(docs, model).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "sentences",
    )
