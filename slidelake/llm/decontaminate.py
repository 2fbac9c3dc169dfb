"""Benchmark decontamination with a BM25 index of test items.

Every passage of every training text is a query against an inverted index of
the items.  Impacts are shares of an item's own best score, so one threshold
serves all items.  As in block-max WAND, a passage is only looked at if it holds
a term past the pivot (what lies before cannot reach the threshold alone), then
only blocks of items whose block maxima reach the threshold are scored.  Hits
count when the passage overlaps with both the item's question and its answer.
Items of few words are looked up as whole sequences of words instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.llm.batches import bytes_of, each_batch, pack, select_places
from slidelake.llm.learn import Vocabulary
from slidelake.llm.textops import LOWER, SPACE, hash_runs, hash_spans, splits, words
from slidelake.session import cut_lineage

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach.
THRESHOLD = 0.7
#: Share of the word triples of question and of answer that must occur.
OVERLAP = 0.8
#: Items with fewer words count where all their words occur in a row; shares of so few triples say little.
MIN_ITEM_WORDS = 8
PASSAGE_STEP = 64
BLOCK_ITEMS = 16
#: Items of one index; larger benchmarks are searched index by index.
INDEX_ITEMS = 4096
_GRAM = 3
_BREAK = SPACE.copy()
_BREAK[:128] = True
for _low, _high in ((48, 58), (65, 91), (97, 123)):
    _BREAK[_low:_high] = False
_STOP = np.isin(np.arange(256), np.frombuffer(b".!?\n", np.uint8))


def tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document, start and end of each word; words are letters, digits and all characters outside ASCII."""
    low = LOWER[buf]
    starts, ends, doc = words(low, offsets, _BREAK)
    return hash_spans(low, starts, ends), doc, starts, ends


def _grams(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """Distinct word triples and their width; a shorter sequence counts as one."""
    width = min(_GRAM, len(hashes))
    return width, np.unique(hash_runs(hashes, width)) if width else hashes


class Totals(NamedTuple):
    """What a score needs to know of the whole benchmark, items of few words left out."""

    items: int
    words: int
    longest: int
    terms: np.ndarray  # sorted hashes, those of the index's own items at least
    df: np.ndarray  # items with each term


def count_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of every text, and the distinct terms of each text of enough words with its position."""
    hashes, doc, _, _ = tokens(*bytes_of(texts))
    count = np.bincount(doc, minlength=len(texts))
    long = count[doc] >= MIN_ITEM_WORDS
    pairs = np.unique(np.stack((doc[long].astype(np.uint64), hashes[long]), axis=1), axis=0)
    return count, pairs[:, 1], pairs[:, 0].astype(np.int64)


class Index:
    """Inverted index of items: impacts by term, block maxima and the terms past the pivot.

    ``totals`` tells of all items where these are only a part of them.
    """

    def __init__(self, ids: list, texts: pa.Array, threshold: float = THRESHOLD, totals: Totals | None = None):
        buf, offsets = bytes_of(texts)
        hashes, doc, starts, ends = tokens(buf, offsets)
        count = np.bincount(doc, minlength=len(ids))
        used = np.flatnonzero(count >= MIN_ITEM_WORDS)
        first = np.concatenate(([0], np.cumsum(count)))
        short = np.flatnonzero((count > 0) & (count < MIN_ITEM_WORDS))
        self.ids = [ids[i] for i in (*used, *short)]
        self.short = self._short([hashes[first[i] : first[i + 1]] for i in short], len(used))
        self.longest = totals.longest if totals else int(count[used].max(initial=1))
        self.question, self.answer = [], []
        stops = np.concatenate(([0], np.cumsum(_STOP[buf])))
        for i in used:
            own = hashes[first[i] : first[i + 1]]
            # The answer is the last sentence, or the last third of a single one.
            ended = stops[starts[first[i] + 1 : first[i + 1]]] > stops[ends[first[i] : first[i + 1] - 1]]
            cut = np.flatnonzero(ended)
            at = int(cut[-1]) + 1 if len(cut) else len(own) - max(1, len(own) // 3)
            self.question.append(_grams(own[:at]))
            self.answer.append(_grams(own[at:]))
        self.terms = Vocabulary(hashes[np.isin(doc, used)])
        n, blocks = len(used), -(-len(used) // BLOCK_ITEMS)
        self.impact = np.zeros((blocks, self.terms.size + 1, BLOCK_ITEMS), np.float32)
        if not n:
            self.ceiling = np.zeros((0, 1), np.float32)
            self.pivot = np.zeros((1, 0), bool)
            return
        tf = np.zeros((self.terms.size, n), np.float32)
        for k, i in enumerate(used):
            np.add.at(tf[:, k], self.terms.of(hashes[first[i] : first[i + 1]]), 1)
        df = totals.df[np.searchsorted(totals.terms, self.terms.keys)] if totals else (tf > 0).sum(axis=1)
        every = totals.items if totals else n
        mean = totals.words / totals.items if totals else count[used].mean()
        idf = np.log1p((every - df + 0.5) / (df + 0.5))
        score = idf[:, None] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * count[used] / mean))
        score /= score.sum(axis=0)
        # Past the pivot: common terms first, what is left once their sum could reach the threshold.
        order = np.argsort(-df, kind="stable")
        past = np.zeros(score.shape, bool)
        past[order] = (np.cumsum(score[order], axis=0) >= threshold - 1e-4) & (score[order] > 0)
        self.pivot = np.zeros((self.terms.size + 1, blocks), bool)
        for b in range(blocks):
            part = slice(b * BLOCK_ITEMS, min(n, (b + 1) * BLOCK_ITEMS))
            self.impact[b, : self.terms.size, : part.stop - part.start] = score[:, part]
            self.pivot[: self.terms.size, b] = past[:, part].any(axis=1)
        self.ceiling = self.impact.max(axis=2)  # block maxima by block and term

    @staticmethod
    def _short(sequences: list[np.ndarray], at: int) -> dict[int, tuple[Vocabulary, list[list[int]]]]:
        """Sequences by their number of words: the distinct ones, and the items of each."""
        found: dict[int, dict[int, list[int]]] = {}
        for k, own in enumerate(sequences):
            found.setdefault(len(own), {}).setdefault(int(hash_runs(own, len(own))[0]), []).append(at + k)
        return {n: (Vocabulary(np.array(list(x), np.uint64)), [x[key] for key in sorted(x)]) for n, x in found.items()}

    def state(self) -> dict:
        return self.__dict__ | {"terms": self.terms.keys, "short": {n: (known.keys, items) for n, (known, items) in self.short.items()}}

    @classmethod
    def of(cls, state: dict) -> Index:
        index = cls.__new__(cls)
        short = {n: (Vocabulary(keys), items) for n, (keys, items) in state["short"].items()}
        index.__dict__.update(state | {"terms": Vocabulary(state["terms"]), "short": short})
        return index

    def search(self, buf: np.ndarray, offsets: np.ndarray, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple]:
        """``(document, item, score, question share, answer share)`` of confirmed hits, the best passage of each pair."""
        if not self.ids or not len(buf):
            return []
        hashes, doc, _, _ = tokens(buf, offsets)
        term = self.terms.of(hashes)
        count = np.bincount(doc, minlength=len(offsets) - 1)
        first = np.concatenate(([0], np.cumsum(count)))
        step = max(PASSAGE_STEP, self.longest)  # an item fits whole into some passage of two steps
        each = np.maximum(1, -(-(count - step) // step)) * (count > 0)
        owner = np.repeat(np.arange(len(count)), each)
        number = np.arange(len(owner)) - np.repeat(np.concatenate(([0], np.cumsum(each)[:-1])), each)
        begin = first[owner] + number * step
        end = np.minimum(begin + 2 * step, first[owner + 1])
        # Passages with a term past the pivot, by block.
        useful = np.flatnonzero(self.pivot.any(axis=1)[term])
        low, high = np.searchsorted(useful, begin), np.searchsorted(useful, end)
        picked = np.flatnonzero(high > low)
        best: dict[tuple[int, int], tuple] = {}
        for width, (known, items) in self.short.items():
            at = known.of(hash_runs(hashes, width))
            met = np.flatnonzero(at < known.size)
            met = met[doc[met] == doc[met + width - 1]]
            for d, k in np.unique(np.stack((doc[met], at[met]), axis=1), axis=0).tolist():
                best.update({(d, item): (1.0, 1.0, 1.0) for item in items[k]})
        for at in range(0, len(picked), 2048):
            p = picked[at : at + 2048]
            place = begin[p][:, None] + np.arange(2 * step)
            inside = place < end[p][:, None]
            grid = np.where(inside, term[np.minimum(place, len(term) - 1)], self.terms.size)
            grid.sort(axis=1)
            grid[:, 1:][grid[:, 1:] == grid[:, :-1]] = self.terms.size  # a term counts once
            for b in range(len(self.ceiling)):
                near = np.flatnonzero(self.pivot[:, b][grid].any(axis=1))
                near = near[self.ceiling[b][grid[near]].sum(axis=1) >= threshold - 1e-4]
                if not len(near):
                    continue
                scores = self.impact[b][grid[near]].sum(axis=1)
                for i, k in zip(*np.nonzero(scores >= threshold - 1e-4)):
                    self._confirm(best, int(p[near[i]]), b * BLOCK_ITEMS + int(k), float(scores[i, k]), hashes, owner, begin, end, overlap)
        return [(*key, *value) for key, value in sorted(best.items())]

    def _confirm(self, best, passage, item, score, hashes, owner, begin, end, overlap) -> None:
        own = hashes[begin[passage] : end[passage]]
        shares = []
        for width, part in (self.question[item], self.answer[item]):
            shares.append(float(np.isin(part, hash_runs(own, width)).mean()) if width else 1.0)
        if min(shares) >= overlap:
            key = (int(owner[passage]), item)
            if key not in best or best[key][0] < score:
                best[key] = (score, *shares)


def _totals(items: DataFrame) -> Callable[[int], Totals]:
    """Totals of ``items(item_id, text, part)``, with the terms of one part at a time."""

    def count(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in arrow:
            n, terms, at = count_words(piece.column(0))
            part = piece.column(1).to_numpy(zero_copy_only=False)
            long = n[n >= MIN_ITEM_WORDS]
            # Term null: the items, their words and the longest.
            columns = [
                pa.array([None, *terms.view(np.int64)], pa.int64()), pa.array([None, *part[at]], pa.int64()),
                pa.array([len(long), *np.ones(len(at), np.int64)], pa.int64()), pa.array([int(long.sum()), *np.zeros(len(at), np.int64)], pa.int64()),
                pa.array([int(long.max(initial=1)), *np.zeros(len(at), np.int64)], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["term", "part", "n", "words", "longest"])

    counted = items.select("text", F.col("part").cast("bigint").alias("part")).mapInArrow(count, "term bigint, part bigint, n bigint, words bigint, longest bigint")
    summed = cut_lineage(
        counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("words").alias("words"), F.max("longest").alias("longest"), F.collect_set("part").alias("parts"))
    )
    top = summed.filter("term IS NULL").first()

    def of(part: int) -> Totals:
        own = summed.filter(F.col("term").isNotNull() & F.array_contains("parts", F.lit(part).cast("bigint"))).select("term", "n").toArrow()
        terms, df = own["term"].to_numpy().view(np.uint64), own["n"].to_numpy()
        order = np.argsort(terms)
        return Totals(top.n, top.words, top.longest, terms[order], df[order])

    return of


def find_hits(packed: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``(place, item_id, score, question_share, answer_share)`` for each confirmed pair of text and item.

    ``benchmark(item_id, text)`` may hold null texts and ids and repeated rows;
    texts without words are not searched for, those of few words as a whole sequence.
    Items go into indexes of bounded size, each held against all texts; weights of
    terms and the length of passages are those of all items together.
    """
    spark = packed.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull())
    parts = max(1, -(-items.count() // INDEX_ITEMS))
    schema = "place bigint, item_id bigint, score double, question_share double, answer_share double"
    names = ["place", "item_id", "score", "question_share", "answer_share"]
    found = None
    items = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    whole = _totals(items) if parts > 1 else None
    for part in range(parts):
        own = items.filter(F.col("part") == part).orderBy("item_id", "text").select("item_id", "text").toArrow()
        texts = own["text"].combine_chunks() if own.num_rows else pa.array([], pa.string())
        index = Index(own["item_id"].to_pylist(), texts, threshold, whole and whole(part))
        shared = spark.sparkContext.broadcast(index.state())  # at most INDEX_ITEMS items

        def search(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = Index.of(shared.value)
            for batch in each_batch(frames):
                rows = []
                for begin, end in splits(np.diff(batch.offsets), 1 << 20):
                    part = batch.offsets[begin : end + 1]
                    for doc, item, *rest in index.search(batch.buf[part[0] : part[-1]], part - part[0], threshold, overlap):
                        rows.append((int(batch.places[begin + doc]), index.ids[item], *rest))
                yield pd.DataFrame(rows, columns=names).astype({"item_id": "Int64"})

        hits = packed.select("batch", "payload").mapInPandas(search, schema)
        found = hits if found is None else found.unionByName(hits)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """``(doc_id, contaminated, item_ids, score)`` of every row of ``docs(doc_id, text)``.

    Null and empty texts and empty benchmarks give no contamination; ids may be
    null or repeat, each row is judged for itself; other columns are ignored.
    ``score`` is the best hit's share of its item's own score, else null.
    """
    packed = pack(docs)
    hits = find_hits(packed, benchmark, threshold, overlap).groupBy("place").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("score").alias("score")
    )

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in each_batch(frames):
            yield pd.DataFrame({"place": batch.places, "doc_id": pd.array(batch.ids.to_pylist(), "Int64")})

    every = packed.mapInPandas(rows, "place bigint, doc_id bigint")
    return every.join(hits, "place", "left").select(
        "doc_id", F.col("score").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), "score",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item of the benchmark."""
    packed = pack(docs, carry=True)
    return select_places(docs, packed, find_hits(packed, benchmark).select("place").distinct(), keep=False)
