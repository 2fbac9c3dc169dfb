"""Alignment of two tokenizers over a corpus, with corpus-wide counts of linked id pairs.

Both tokenizers encode a blank and the text.  Places where tokens of both end
cut them into groups, and two tokens that end together are linked.  Counting
goes in two passes over the documents.  The first aligns and keeps the pairs of
each task; the distinct pairs get a minimal perfect hash, and every task's
counts become dense vectors indexed by it, which are added up a tree.  The
second aligns again and looks the counts up; stored keys verify each look-up.

Linked tokens end at the same byte of the same text, so one is a suffix of the
other.  ``most_pairs`` counts such pairs of two vocabularies, which bounds the
hash, the vectors and all that is sent to tasks, whatever the corpus holds.

Null and empty texts, and texts that either tokenizer does not give back byte
for byte, have no tokens and count nothing.  Repeated rows each count and each
come out; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
import tiktoken
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.llm.batches import release_memory
from slidelake.llm.textops import mix
from slidelake.operators.grouping import map_sorted_groups
from slidelake.session import cut_lineage

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"
BUCKET_BITS = 6
FAN_IN = 16
#: Distinct chunks and their characters that a task remembers before it starts anew.
KNOWN_CHUNKS, KNOWN_CHARS = 300_000, 16 << 20
_SLICE_CHARS = 1 << 20
LINE = 1000  # chunks that meet a tokenizer in one call
# Fixed value: how byte-level vocabularies part text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SETTLED = "\u0250"  # letters below have had their kinds since long ago
U64 = np.uint64
EMPTY = np.zeros(0, np.int64)


# --- One pair of tokenizers --------------------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class TokenizerPair:
    """Both tokenizers from their files' contents; loaded once in each worker."""

    def __init__(self, a_json: str, b_model: bytes):
        self.source = a_json, b_model

    def __getstate__(self):
        return {"source": self.source}

    def load(self) -> TokenizerPair:
        if hasattr(self, "a"):
            return self
        a_json, b_model = self.source
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        self.a = tokenizers.Tokenizer.from_str(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        letters = byte_letters()
        self.a_bytes = [
            bytes(letters[c] for c in piece) if all(c in letters for c in piece) else piece.encode()
            for piece in (self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size()))
        ]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_sizes, self.b_sizes = (np.array([len(v) for v in voc], np.int64) for voc in (self.a_bytes, self.b_bytes))
        self.quick = _quick_encoder(json.loads(a_json), self.a_bytes)
        # Ids as they are written: A's in a group and last in it; B's in a group, last in it, last in a chunk.
        self.written = [f"{i}{c}" for i in range(len(self.a_bytes)) for c in ",|"] + [f"{i}{c}" for i in range(len(self.b_bytes)) for c in ",;\n"]
        self.blanks = blank_letters()
        self.border = re.compile(f"(?<=[^{re.escape(''.join(sorted(self.blanks)))}])(?= )")
        # Chunks may be encoded on their own where no token of either reaches over a border.
        parts = json.loads(a_json)
        before = parts.get("pre_tokenizer") or {}
        self.local = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and parts.get("normalizer") is None and not any("▁" in p.lstrip("▁") for p in pieces)
        )
        return self

    def chunks(self, texts: list[str]) -> list[list[str]]:
        """Each ``" " + text`` in pieces that both tokenizers encode as they do in the whole, less a blank before each.

        Neither joins anything but a blank letter with a blank behind it, so
        every other letter before a blank ends a piece.
        """
        if not self.local:
            return [[t] for t in texts]
        odd = [c + " " for c in self.blanks & set().union(*texts)]
        out = []
        for t in texts:
            if t[0] != " " != t[-1] and not any(o in t for o in odd):
                out.append(t.split(" "))
                continue
            parts = self.border.split(" " + t)
            if parts[-1] == " " and len(parts) > 1:  # B's model adds no blank to nothing
                parts[-2:] = [parts[-2] + " "]
            out.append([p[1:] for p in parts])
        return out

    def encode(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and of B one after the other, how many each chunk has, and which chunks come back byte for byte.

        Chunks go to the tokenizers as lines of many; a chunk that ends in a blank letter ends its line.
        """
        parts, line = [], []
        for k in keys:
            line.append(k)
            if len(line) == LINE or k[-1:] in self.blanks or not self.local:
                parts.append(self._encode_line(line))
                line = []
        if line:
            parts.append(self._encode_line(line))
        return tuple(np.concatenate(side) for side in zip(*parts))

    def _encode_line(self, keys: list[str]) -> tuple[np.ndarray, ...]:
        line = " ".join(keys)
        raw = (" " + line).encode()
        sizes = np.fromiter(map(len, keys), np.int64, len(keys)) + 1
        if len(raw) != len(line) + 1:
            sizes = np.array([len(k.encode()) + 1 for k in keys], np.int64)
        ends, sides = np.cumsum(sizes), []
        quick = self.quick is not None and max(line) < _SETTLED
        a_ids = self.quick.encode_ordinary(" " + line) if quick else self.a.encode(" " + line, add_special_tokens=False).ids
        sources = (
            (a_ids, self.a_bytes, self.a_sizes),
            (self.b.encode(line), self.b_bytes, self.b_sizes),  # the model adds the first blank
        )
        for ids, voc, widths in sources:
            flat = np.array(ids, np.int64)
            through = np.searchsorted(np.cumsum(widths[flat]), ends, "right")
            if b"".join([voc[i] for i in ids]) != raw:
                if len(keys) == 1:
                    return (*[np.zeros(n, np.int64) for n in (0, 1, 0, 1)], np.zeros(1, bool))
                alone = [self._encode_line([k]) for k in keys]
                return tuple(np.concatenate(side) for side in zip(*alone))
            sides += [flat, np.diff(through, prepend=0)]
        return (*sides, np.ones(len(keys), bool))


def _quick_encoder(file: dict, voc: list[bytes]) -> tiktoken.Encoding | None:
    """The same vocabulary in a faster encoder, where ids follow the order of the merges; else None.

    It is used for Latin letters alone: of others two libraries might know different kinds.
    """
    model, before = file["model"], file.get("pre_tokenizer") or {}
    if model.get("type", "BPE") != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or file.get("normalizer") or before.get("add_prefix_space"):
        return None
    merged = [model["vocab"].get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1)) for m in model["merges"]]
    special = {t["id"] for t in file.get("added_tokens", [])}
    ranks = {v: i for i, v in enumerate(voc) if i not in special}
    if None in merged or merged != sorted(merged) or len(ranks) != 256 + len(merged) or len(model["vocab"]) - len(special & set(model["vocab"].values())) != len(ranks):
        return None
    return tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache
def blank_letters() -> frozenset[str]:
    """Letters that some rule may take for white space: separators, controls and formats."""
    every = map(chr, range(0x110000))
    return frozenset(c for c in every if unicodedata.category(c) in ("Cc", "Cf", "Zs", "Zl", "Zp"))


def most_pairs(pair: TokenizerPair) -> int:
    """How many id pairs can be linked at all: those whose bytes are suffixes of one another."""
    pair.load()
    of_a, of_b = Counter(pair.a_bytes), Counter(pair.b_bytes)
    longer_a = sum(of_b[v[k:]] for v in pair.a_bytes for k in range(len(v) + 1))
    return longer_a + sum(of_a[v[k:]] for v in pair.b_bytes for k in range(1, len(v) + 1))


def align(fa: np.ndarray, na: np.ndarray, fb: np.ndarray, nb: np.ndarray, pair: TokenizerPair):
    """Groups and links of all chunks together; ids one after the other, and how many a chunk has.

    Both sides of a chunk hold the same bytes, so running byte ends compare
    across chunks.  Gives the written groups, groups per chunk, link keys
    ``a << 32 | b`` and links per chunk.
    """
    ends_a, ends_b = np.cumsum(pair.a_sizes[fa]), np.cumsum(pair.b_sizes[fb])
    last = ends_a[np.cumsum(na) - 1]  # where chunks end; both sides end there
    cuts = ends_a[_within(ends_a, ends_b) & (np.diff(ends_a, prepend=-1) > 0)]
    # Tokens of a group are those with an end up to its cut; an empty token belongs to the group it ends in.
    in_a, in_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    through_a, through_b = np.searchsorted(in_a, np.arange(len(cuts)), "right"), np.searchsorted(in_b, np.arange(len(cuts)), "right")
    groups = np.diff(np.searchsorted(cuts, last, "right"), prepend=0)
    # Written form: a group's A ids before its B ids.
    codes = np.empty(len(fa) + len(fb), np.int64)
    before_b = np.concatenate([[0], through_b])[in_a]
    ending_a, ending_b = through_a[in_a] == np.arange(len(fa)) + 1, through_b[in_b] == np.arange(len(fb)) + 1
    codes[np.arange(len(fa)) + before_b] = 2 * fa + ending_a
    chunk_end = _within(cuts, last)[in_b]
    codes[np.arange(len(fb)) + through_a[in_b]] = 2 * len(pair.a_bytes) + 3 * fb + np.where(ending_b, 1 + chunk_end, 0)
    table = pair.written
    written = "".join([table[c] for c in codes.tolist()]).split("\n")[:-1]
    # A cut links the tokens that end in it: one and one, but for empty tokens.
    at_a, at_b = ends_a == cuts[in_a], ends_b == cuts[in_b]
    many_a, many_b = np.bincount(in_a[at_a], minlength=len(cuts)), np.bincount(in_b[at_b], minlength=len(cuts))
    if (many_a == 1).all() and (many_b == 1).all():
        keys, where = (fa[at_a] << 32) | fb[at_b], np.arange(len(cuts))
    else:
        left, right = pd.DataFrame({"cut": in_a[at_a], "a": fa[at_a]}), pd.DataFrame({"cut": in_b[at_b], "b": fb[at_b]})
        both = left.merge(right, on="cut")
        keys, where = (both["a"].to_numpy() << 32) | both["b"].to_numpy(), both["cut"].to_numpy()
    links = np.bincount(np.searchsorted(last, cuts[where]), minlength=len(na))
    return written, groups, keys, links


def _within(values: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which values occur among the others; both are sorted, the others are not empty."""
    return others[np.minimum(np.searchsorted(others, values), len(others) - 1)] == values


class _Numbers(dict):
    """Numbers for keys as they are first asked for."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class Chunks:
    """What a task knows of the chunks it has met: sizes, links and written groups of each."""

    def __init__(self, pair: TokenizerPair):
        self.pair = pair
        self.number = _Numbers()
        self.chars = 0
        self.sizes = np.zeros((0, 4), np.int64)  # a, b, groups, links
        self.good = np.zeros(0, bool)
        self.links = EMPTY  # of all chunks, one after the other
        self.written: list[str] = []

    @property
    def full(self) -> bool:
        return len(self.number) > KNOWN_CHUNKS or self.chars > KNOWN_CHARS

    def learn(self, texts: list[str]) -> list[np.ndarray]:
        """Chunk numbers of each text; unknown chunks are aligned."""
        first = len(self.number)
        ask = self.number.__getitem__
        out = [np.array(list(map(ask, keys)), np.int64) for keys in self.pair.chunks(texts)]
        fresh = list(islice(self.number, first, None))
        if fresh:
            self._learn(fresh)
        return out

    def _learn(self, keys: list[str]) -> None:
        fa, na, fb, nb, good = self.pair.encode(keys)
        sizes, written = np.zeros((len(keys), 4), np.int64), np.full(len(keys), "", object)
        if good.any():
            fa, fb, na, nb = fa[np.repeat(good, na)], fb[np.repeat(good, nb)], na[good], nb[good]
            written[good], groups, links, many = align(fa, na, fb, nb, self.pair)
            sizes[good] = np.stack([na, nb, groups, many], axis=1)
            self.links = np.concatenate([self.links, links])
        self.sizes, self.good = np.concatenate([self.sizes, sizes]), np.concatenate([self.good, good])
        self.written += written.tolist()
        self.chars += sum(map(len, keys))

    def links_of(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Link keys of the given chunks and whose they are, by place in ``chunks``."""
        many, ends = self.sizes[chunks, 3], np.cumsum(self.sizes[:, 3])
        owner = np.repeat(np.arange(len(chunks)), many)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        return self.links[(ends[chunks] - many)[owner] + inside], owner


def _slices(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts, some megabyte at once."""
    for frame in frames:
        lengths = pa.compute.fill_null(pa.compute.binary_length(frame.column(1)), 0).to_numpy(zero_copy_only=False)
        begin = size = 0
        for i, n in enumerate(lengths.tolist()):
            if i > begin and size + n > _SLICE_CHARS:
                yield frame.column(0)[begin:i], frame.column(1)[begin:i].to_pylist()
                begin, size = i, 0
            size += n
        if begin < len(lengths):
            yield frame.column(0)[begin:], frame.column(1)[begin:].to_pylist()


# --- Minimal perfect hash ----------------------------------------------------------------------


class PerfectHash:
    """Numbers 0 to n-1 for n distinct keys: a key sits in the first level where its place is its own."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, self.size = [], 0
        for bits in levels:
            self.ranks.append(self.size + np.cumsum(bits) - 1)
            self.size += int(bits.sum())

    @staticmethod
    def _place(keys: np.ndarray, level: int, width: int) -> np.ndarray:
        return (mix(keys ^ mix(np.array([level + 1], U64))) % U64(width)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, rest = [], keys.astype(U64)
        while len(rest):
            width = max(64, 2 * len(rest))
            at = cls._place(rest, len(levels), width)
            alone = np.bincount(at, minlength=width) == 1
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; a key that was not built in gets any number or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo, left = np.arange(len(keys)), keys.astype(U64)
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            if not len(left):
                break
            at = self._place(left, level, len(bits))
            hit = bits[at]
            out[todo[hit]] = ranks[at[hit]]
            todo, left = todo[~hit], left[~hit]
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], np.int64)
        return head.tobytes() + b"".join(np.packbits(b).tobytes() for b in self.levels)

    @classmethod
    def restore(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        widths, at, levels = np.frombuffer(data, np.int64, n, 8), 8 * (n + 1), []
        for width in widths.tolist():
            size = -(-width // 8)
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=width).astype(bool))
            at += size
        return cls(levels)


class PairIndex:
    """Buckets of distinct pairs, each with its hash and its keys in the hash's order."""

    def __init__(self, rows: Iterable[tuple[int, bytes, bytes]]):
        self.rows = list(rows)
        self.counts: list[np.ndarray] | None = None
        self.best: np.ndarray = EMPTY

    def __getstate__(self):
        return {"rows": self.rows, "counts": self.counts, "best": self.best}

    def bucket(self, number: int) -> tuple[PerfectHash, np.ndarray] | None:
        if not hasattr(self, "open"):
            self.open = {k: (PerfectHash.restore(h), np.frombuffer(keys, np.int64)) for k, h, keys in self.rows}
        return self.open.get(number)

    def find(self, bucket: int, keys: np.ndarray) -> np.ndarray:
        """Number of each key inside its bucket, verified against the stored keys."""
        found = self.bucket(bucket)
        at = np.full(len(keys), -1, np.int64) if found is None else found[0](keys)
        if len(at) and (at.min() < 0 or (found[1][at] != keys).any()):
            raise RuntimeError("a pair has no count: the documents differ between the two passes")
        return at

    def with_counts(self, totals: dict[int, np.ndarray]) -> PairIndex:
        """Adds the count of every pair and the highest count of every B id."""
        out = PairIndex(self.rows)
        out.counts = {k: totals[k] for k, _, _ in self.rows}
        keys = [self.bucket(k)[1] for k, _, _ in self.rows]
        width = max((int((k & 0xFFFFFFFF).max()) + 1 for k in keys), default=0)
        out.best = np.zeros(width, np.int64)
        for (number, _, _), k in zip(self.rows, keys):
            np.maximum.at(out.best, k & 0xFFFFFFFF, totals[number])
        return out

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        for number, at in by_bucket(keys):
            out[at] = self.counts[number][self.find(number, keys[at])]
        return out


def by_bucket(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Positions of the keys of each bucket that has any."""
    buckets = (mix(keys.astype(U64)) >> U64(64 - BUCKET_BITS)).astype(np.int64)
    order = np.argsort(buckets, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(buckets[order])) + 1):
        if len(at):
            yield int(buckets[at[0]]), at


def _add(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their summed counts."""
    found, where = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(found), np.int64)
    np.add.at(sums, where, counts)
    return found, sums


# --- Both passes -------------------------------------------------------------------------------


def _task_counts(docs: DataFrame, shared) -> DataFrame:
    """First pass: one row ``(part, pairs, counts)`` per task, of distinct pairs."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = shared.value.load()
        keys, sums = EMPTY, EMPTY
        known, times = Chunks(pair), np.zeros(0, np.int64)

        def fold():
            return _add(np.concatenate([keys, known.links]), np.concatenate([sums, np.repeat(times, known.sizes[:, 3])]))

        for _, texts in _slices(frames):
            numbers = known.learn([t for t in texts if t])
            whole = [n for n in numbers if known.good[n].all()]
            times = np.concatenate([times, np.zeros(len(known.good) - len(times), np.int64)])
            if whole:
                times += np.bincount(np.concatenate(whole), minlength=len(times))
            if known.full:
                keys, sums = fold()
                known, times = Chunks(pair), np.zeros(0, np.int64)
                release_memory()
        keys, sums = fold()
        seen = sums > 0
        if seen.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([keys[seen].tobytes()]), pa.array([sums[seen].tobytes()])],
                ["part", "pairs", "counts"],
            )

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut_lineage(narrow.mapInArrow(run, "part int, pairs binary, counts binary"))


def _index_pairs(parts: DataFrame) -> PairIndex:
    """A perfect hash over the distinct pairs of all tasks, built bucket by bucket."""

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for pairs in frame["pairs"]:
                keys = np.frombuffer(pairs, np.int64)
                yield pd.DataFrame([(k, keys[at].tobytes()) for k, at in by_bucket(keys)], columns=["bucket", "pairs"])

    def build(key: tuple, rows: Iterable) -> Iterable[tuple]:
        keys = EMPTY
        for r in rows:
            keys = np.union1d(keys, np.frombuffer(r.pairs, np.int64))
        hashed = PerfectHash.build(keys)
        ordered = np.empty_like(keys)
        ordered[hashed(keys)] = keys
        yield key[0], hashed.dump(), ordered.tobytes()

    dealt = parts.select("pairs").mapInPandas(deal, "bucket int, pairs binary")
    built = map_sorted_groups(dealt, ["bucket"], [], build, "bucket int, hash binary, keys binary", ["bucket", "hash", "keys"])
    # At most ``most_pairs`` keys, whatever the corpus.
    return PairIndex((r.bucket, bytes(r.hash), bytes(r["keys"])) for r in built.collect())


def _totals(parts: DataFrame, index: PairIndex) -> dict[int, np.ndarray]:
    """Counts of every bucket's pairs: dense vectors of all tasks, added up a tree."""
    if not index.rows:
        return {}
    shared = parts.sparkSession.sparkContext.broadcast(index)

    def lay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for part, pairs, counts in zip(frame["part"], frame["pairs"], frame["counts"]):
                keys, sums, out = np.frombuffer(pairs, np.int64), np.frombuffer(counts, np.int64), []
                for number, at in by_bucket(keys):
                    dense = np.zeros(shared.value.bucket(number)[0].size, np.int64)
                    dense[shared.value.find(number, keys[at])] = sums[at]
                    out.append((number, part, dense.tobytes()))
                yield pd.DataFrame(out, columns=["bucket", "node", "counts"])

    def add(key: tuple, rows: Iterable) -> Iterable[tuple]:
        total = None
        for r in rows:
            dense = np.frombuffer(r.counts, np.int64)
            total = dense.copy() if total is None else total + dense
        yield (*key, total.tobytes())

    schema = "bucket int, node int, counts binary"
    vectors = parts.mapInPandas(lay, schema)
    nodes = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        up = vectors.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("int"))
        vectors = map_sorted_groups(up, ["bucket", "node"], [], add, schema, ["bucket", "node", "counts"])
        nodes = -(-nodes // FAN_IN)
        if nodes == 1:
            return {r.bucket: np.frombuffer(bytes(r.counts), np.int64) for r in vectors.collect()}


class Alignment:
    """Two tokenizers, and the counts of their linked pairs over one corpus."""

    def __init__(self, docs: DataFrame, a_path: str = TOKENIZER_A, b_path: str = TOKENIZER_B):
        with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
            self.pair = TokenizerPair(a.read(), b.read())
        self.docs = docs
        self.context = docs.sparkSession.sparkContext
        self.tokenizers = self.context.broadcast(self.pair)  # two vocabulary files
        self.parts = _task_counts(docs, self.tokenizers)
        index = _index_pairs(self.parts)
        self.index = index.with_counts(_totals(self.parts, index))

    def pair_counts(self) -> DataFrame:
        """``(a_id, b_id, count)`` of every linked pair."""
        tables = [
            pa.table({"a_id": keys >> 32, "b_id": keys & 0xFFFFFFFF, "count": self.index.counts[number]})
            for number, _, raw in self.index.rows for keys in [np.frombuffer(raw, np.int64)]
        ]
        spark = self.docs.sparkSession
        if not tables:
            return spark.createDataFrame([], "a_id bigint, b_id bigint, count bigint")
        return spark.createDataFrame(pa.concat_tables(tables))

    def documents(self) -> DataFrame:
        """Second pass: per row of the documents its sizes, its counts and its written groups.

        ``groups`` reads ``a1,a2|b1;a3|b2,b3``; it is empty without tokens.
        """
        tokens, counts = self.tokenizers, self.context.broadcast(self.index)  # bounded by ``most_pairs``
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair, index = tokens.value.load(), counts.value
            known, facts, judged = Chunks(pair), np.zeros((0, 6), np.int64), np.zeros(0, bool)

            def judge(chunks: np.ndarray) -> np.ndarray:
                """Sizes, best links and summed counts of the given chunks."""
                flat, owner = known.links_of(chunks)
                found = index.look_up(flat)
                out = np.zeros((len(chunks), 6), np.int64)
                out[:, :4] = known.sizes[chunks]
                if len(flat):
                    best = found == index.best[flat & 0xFFFFFFFF]
                    out[:, 4] = np.bincount(owner[best], minlength=len(chunks))
                    np.add.at(out[:, 5], owner, found)
                return out

            for ids, texts in _slices(frames):
                numbers = iter(known.learn([t for t in texts if t]))
                grown = len(known.sizes) - len(facts)
                facts, judged = np.concatenate([facts, np.zeros((grown, 6), np.int64)]), np.concatenate([judged, np.zeros(grown, bool)])
                whole = [(i, n) for i, n in ((i, next(numbers)) for i, t in enumerate(texts) if t) if known.good[n].all()]
                # Only texts with tokens were counted, so only their chunks are looked up.
                used = np.unique(np.concatenate([EMPTY, *[n for _, n in whole]]))
                used = used[~judged[used]]
                if len(used):
                    facts[used], judged[used] = judge(used), True
                rows, told = np.zeros((len(texts), 6), np.int64), [""] * len(texts)
                for i, n in whole:
                    rows[i] = facts[n].sum(axis=0)
                    told[i] = ";".join([known.written[k] for k in n.tolist()])
                arrays = [ids.cast(pa.int64()), *[pa.array(rows[:, k]) for k in range(6)], pa.array(told, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names)
                if known.full:
                    known, facts, judged = Chunks(pair), np.zeros((0, 6), np.int64), np.zeros(0, bool)
                    release_memory()

        narrow = self.docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return narrow.mapInArrow(
            run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string"
        )
