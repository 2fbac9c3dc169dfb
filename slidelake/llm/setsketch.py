"""Near-duplicate classes with SetSketch registers.

A document is its set of word shingles.  A sketch keeps, for each register, the
exponent of the smallest exponentially distributed hash of the set: an
exponentially spaced, truncated minimum, so sketches of unions are register-wise
maxima, and equal registers mean similar sets.  Groups of registers are bands;
documents that share a band are candidates.  The similarity of candidates is
estimated jointly with the set sizes by maximum likelihood, and only pairs for
which the threshold is implausible are dropped.  All others are confirmed on
their full sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slidelake.llm.batches import Batch, each_batch, pack, release_memory, select_places, shuffle_width
from slidelake.llm.textops import LOWER, hash_runs, hash_spans, mix, words
from slidelake.operators.components import merge_labels
from slidelake.session import cut_lineage

SHINGLE = 5
#: Similarity from which documents are linked, unless the caller says otherwise.
PERCENT = 85
REGISTERS = 512
BAND = 5  # registers of a band
BASE = 1.09
#: A pair is dropped if the threshold is less likely than the best fit by this many nats (under 1 in 100,000 at the threshold).
SLACK = 10.0
#: Members of a bucket that one task compares; larger buckets are compared block by block.
BLOCK = 1024
_FACTORS = (mix(np.arange(1, REGISTERS + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_CHUNK = 256


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; with fewer words, the whole sequence is the one shingle."""
    buf = LOWER[buf]
    starts, ends, doc = words(buf, offsets)
    single = hash_spans(buf, starts, ends)
    runs_ = hash_runs(single, width)
    first = np.searchsorted(doc, np.arange(len(offsets)))
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            found = np.sort(runs_[a : b - width + 1])
            out.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        elif b > a:
            out.append(hash_runs(single[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes; all 0 for an empty set."""
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint8)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    room = np.empty((_CHUNK, REGISTERS), np.uint32)
    for i in range(0, len(low), _CHUNK):
        part = low[i : i + _CHUNK]
        np.multiply(part[:, None], _FACTORS, out=room[: len(part)])
        np.minimum(least, room[: len(part)].min(axis=0), out=least)
    rate = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(rate) / np.log(BASE)), 0, 255).astype(np.uint8)


def _step(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def _equal_share(percent: int) -> float:
    """Chance that a register is equal in two sets of one size at the threshold."""
    return float(1 - 2 * _step(np.float64((1 - percent / 100) / 2)))


def least_equal(percent: int) -> int:
    """Equal registers below which the threshold is out of the question: 7.5 standard deviations under their mean."""
    p = _equal_share(percent)
    return max(0, int(REGISTERS * p - 7.5 * np.sqrt(REGISTERS * p * (1 - p))))


def bands_of(percent: int) -> int:
    """As many bands as leave a pair at the threshold a chance below 1e-8 to miss them all."""
    return min(REGISTERS // BAND, int(np.ceil(np.log(3e-9) / np.log1p(-(_equal_share(percent) ** BAND)))))


def plausible(n_u: np.ndarray, n_v: np.ndarray, above: np.ndarray, below: np.ndarray, percent: int = PERCENT, slack: float = SLACK) -> np.ndarray:
    """Whether a similarity at the threshold or more fits the register counts.

    ``above`` and ``below`` count registers in which the first or the second
    sketch is larger.  Sizes decide exactly where they already exclude it.
    """
    small, large = np.minimum(n_u, n_v), np.maximum(n_u, n_v)
    possible = 100 * small >= percent * large
    u = n_u / (n_u + n_v)
    v, most = 1 - u, small / large
    equal = REGISTERS - above - below

    def fit(j):
        p, q = _step(u - v * j), _step(v - u * j)
        eps = 1e-12
        return above * np.log(p + eps) + below * np.log(q + eps) + equal * np.log(np.maximum(1 - p - q, eps))

    grid = np.linspace(0, 1, 61)
    floor = percent / 100
    best = np.full(len(u), -np.inf)
    over = np.full(len(u), -np.inf)
    for g in grid:
        j = np.minimum(g, most)
        value = fit(j)
        best = np.maximum(best, value)
        if g >= floor:
            over = np.maximum(over, value)
    over = np.maximum(over, fit(np.minimum(floor, most)))
    return possible & (over >= np.maximum(best, over) - slack)


def sketch(packed: DataFrame) -> DataFrame:
    """``(place, doc_id, n_shingles, digest, regs)`` of every packed document, written."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in each_batch(frames):
            known: dict[bytes, bytes] = {}
            rows = []
            for i, found in enumerate(shingle_sets(batch.buf, batch.offsets)):
                other = mix(found ^ np.uint64(0x5851F42D4C957F2D))
                digest = np.array([found.sum(), other.sum()], np.uint64).tobytes() + len(found).to_bytes(4, "little")
                if digest not in known:
                    known[digest] = registers(found).tobytes()
                rows.append((len(found), digest, known[digest]))
            out = pd.DataFrame(rows, columns=["n_shingles", "digest", "regs"])
            out.insert(0, "place", batch.places)
            out.insert(1, "doc_id", pd.array(batch.ids.to_pylist(), "Int64"))
            yield out

    return cut_lineage(packed.mapInPandas(run, "place bigint, doc_id bigint, n_shingles bigint, digest binary, regs binary"))


def _counts(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (a > b).sum(axis=-1), (a < b).sum(axis=-1)


def _regs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, REGISTERS)


def _filter_pairs(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs whose sketches leave the threshold plausible."""
    side = lambda name, n: classes.select(F.col("rep").alias(name), F.col("n").alias(f"n_{name}"), F.col("regs").alias(f"regs_{name}"))
    met = pairs.join(side("a", 1), "a").join(side("b", 2), "b")
    least = least_equal(percent)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                above, below = _counts(_regs(f["regs_a"]), _regs(f["regs_b"]))
                near = REGISTERS - above - below >= least
                f, above, below = f[near], above[near], below[near]
                yield f.loc[plausible(f["n_a"].to_numpy(), f["n_b"].to_numpy(), above, below, percent), ["a", "b"]]

    # Sizes exclude many pairs before any sketch is looked at.
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return met.filter(fits).mapInPandas(run, "a bigint, b bigint")


def _confirm(pairs: DataFrame, packed: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full shingle sets reach the threshold; texts are fetched for these documents only."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("place")).distinct()
    wanted = wanted.groupBy(F.shiftright("place", 16).alias("batch")).agg(F.collect_list("place").alias("places"))

    def fetch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, payload, places in zip(frame["batch"], frame["payload"], frame["places"]):
                batch = Batch(number, payload)
                yield pd.DataFrame({"place": places, "text": [zlib.compress(batch.text(p & 0xFFFF), 1) for p in places]})

    texts = cut_lineage(packed.select("batch", "payload").join(wanted, "batch").mapInPandas(fetch, "place bigint, text binary"))
    side = lambda name: texts.select(F.col("place").alias(name), F.col("text").alias(f"text_{name}"))
    # The last join leaves pairs sorted by their first document, whose set is then made once.
    met = pairs.join(side("b"), "b").join(side("a"), "a")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept = None, None
        for f in frames:
            good = []
            for a, b, ta, tb in zip(f["a"], f["b"], f["text_a"], f["text_b"]):
                if a != last:
                    last, kept = a, _set_of(ta)
                other = _set_of(tb)
                shared = int(np.isin(other, kept, assume_unique=True).sum())
                good.append(100 * shared >= percent * (len(kept) + len(other) - shared))
            yield f.loc[good, ["a", "b"]]

    return met.mapInPandas(run, "a bigint, b bigint")


def _set_of(text: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(text), np.uint8)
    return shingle_sets(raw, np.array([0, len(raw)]))[0]


def _bands(classes: DataFrame, percent: int) -> DataFrame:
    keys = F.array(*[F.xxhash64(F.lit(i), F.expr(f"substring(regs, {1 + BAND * i}, {BAND})")) for i in range(bands_of(percent))])
    return classes.select("rep", F.posexplode(keys).alias("band", "key"))


def _spanning(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the pairs that hold together what all pairs hold together, heaviest first; fewer than there are nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kept = []
    order = np.argsort(-weight, kind="stable")
    for i, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[x] = y
            kept.append(i)
    return np.array(kept, np.int64)


def _blocks(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """``(rep, band, key, label, mine, low, high)``: pairs of blocks in which the members of open buckets meet.

    A bucket is open if it spans several components.  A crowded one is cut into blocks, those of its largest
    component apart from the others: its members need not meet each other, so only members outside it are copied.
    """
    labelled = _labelled(shared.filter("members > 2 AND rep <> hub"), roots)
    open_ = labelled.groupBy("key").agg(F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low < _high").select("key")
    sizes = labelled.filter(F.col("members") > BLOCK).groupBy("key", "label").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.groupBy("key").agg(F.max_by("label", F.struct("_n", "label")).alias("_main"), F.max("_n").alias("_inside"))
    parts = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    inside = F.coalesce(F.col("label") == F.col("_main"), F.lit(False))
    place = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    return (
        labelled.join(open_, "key")
        .join(sizes, "key", "left")
        .withColumn("_outer", F.greatest(parts(F.col("members") - F.coalesce("_inside", F.lit(0))), F.lit(1)))
        .withColumn("_inner", parts(F.coalesce("_inside", F.lit(0))))
        .withColumn("mine", F.when(inside, F.col("_outer") + place(F.col("_inner"))).otherwise(place(F.col("_outer"))))
        # A member meets its own and every other block once: (low, high) names the pair of blocks.
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("_outer") - 1).otherwise(F.col("_outer") + F.col("_inner") - 1))))
        .select("rep", "band", "key", "label", "mine", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"))
    )


def _blocks_left(found: DataFrame, roots: DataFrame) -> DataFrame:
    """As ``_blocks``, of the members that the likely round left with plausible pairs."""
    return _labelled(found.filter("rep IS NOT NULL").drop("a", "b"), roots)


def _labelled(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").withColumn("label", F.coalesce("root", "rep"))


_FOUND = "a bigint, b bigint, rep bigint, band int, key bigint, mine int, low int, high int"


def _across(met: DataFrame, classes: DataFrame, percent: int, likely: bool) -> DataFrame:
    """Plausible pairs of one bucket that are not in one component yet and were not compared with the bucket's first member.

    A pair that shares several bands is looked at in the first of them alone.  With ``likely``, only pairs that seem
    similar enough, and of these as few from a block as hold its components together; rows with ``rep`` then
    name the members of all other plausible pairs of a block, so that nothing else has to meet again.
    """
    least = least_equal(percent)
    met = met.select("rep", "band", "key", "label", "mine", "low", "high").join(classes.select("rep", "n", "regs"), "rep")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("rep")
        rep, label, mine, n, regs = (f[c].to_numpy() for c in ("rep", "label", "mine", "n", "regs"))
        regs = _regs(regs)
        # By register, so that counting goes along long rows of single bytes; 255 ones fit a byte.
        halves = [np.ascontiguousarray(regs[:, k : k + 255].T) for k in (0, 255)]
        blocks = f["low"].iloc[0] != f["high"].iloc[0]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(len(rep) - 1):
            # The cheap count first; only what it leaves is worth a likelihood.
            equal = np.zeros(len(rep) - i - 1, np.uint16)
            for half in halves:
                equal += np.add.reduce((half[:, i + 1 :] == half[:, i : i + 1]).view(np.uint8), axis=0, dtype=np.uint8)
            j = np.flatnonzero(equal >= least - (REGISTERS - 510)) + i + 1
            j = j[(label[j] != label[i]) & (100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i]))]
            if blocks:
                j = j[mine[j] != mine[i]]
            left.append(np.full(len(j), i))
            right.append(j)
        left, right = np.concatenate(left), np.concatenate(right)
        band = int(f["band"].iloc[0])
        if band and len(left):
            before = (regs[left, : BAND * band] == regs[right, : BAND * band]).reshape(-1, band, BAND)
            new = ~before.all(axis=2).any(axis=1)
            left, right = left[new], right[new]
        kept, equal = np.zeros(len(left), bool), np.zeros(len(left), np.int64)
        for at in range(0, len(left), 1 << 14):  # likelihoods of many pairs at once
            x, y = left[at : at + (1 << 14)], right[at : at + (1 << 14)]
            above, below = _counts(regs[x], regs[y])
            equal[at : at + (1 << 14)] = REGISTERS - above - below
            kept[at : at + (1 << 14)] = plausible(n[x], n[y], above, below, percent)
        left, right, equal = left[kept], right[kept], equal[kept]
        out = []
        if likely:
            near = np.flatnonzero(equal >= REGISTERS * _equal_share(percent))
            forest = near[_spanning(label[left[near]], label[right[near]], equal[near])]
            later = np.setdiff1d(np.arange(len(left)), forest)
            at = np.unique(np.concatenate((left[later], right[later])))
            out.append(f.iloc[at][["rep", "band", "key", "mine", "low", "high"]])
            left, right = left[forest], right[forest]
        out.append(pd.DataFrame({"a": rep[left], "b": rep[right]}))
        release_memory()
        return pd.concat([x.astype("Int64") for x in out]).reindex(columns=names).astype("Int64")

    names = [c.split()[0] for c in _FOUND.split(", ")]
    # Comparing is work on few bytes, so it is spread by count and not by size.
    spread = met.repartition(4 * shuffle_width(met), "key", "low", "high")
    return spread.groupBy("key", "low", "high").applyInPandas(run, _FOUND)


def near_duplicates(docs: DataFrame | None = None, packed: DataFrame | None = None, percent: int = PERCENT) -> DataFrame:
    """``(place, doc_id, n_shingles, component_id, kept, chosen, n_same)`` of every document.

    Documents are linked when 100 * intersection >= percent * union of their shingle
    sets; a component holds what links reach and is named by its smallest id.
    Texts without words (null, empty) have no shingle and stand alone.  A null id
    takes part, but names a component only where all ids are null; ``kept`` is
    ``doc_id = component_id``, and ``chosen`` is true for exactly one row of each
    component, repeated rows included.  ``n_same`` counts rows with an equal set.
    Equal sets are one class from the start, so copies never meet in pairs.
    """
    packed = pack(docs) if packed is None else packed
    rows = sketch(packed)
    classes = cut_lineage(
        rows.filter("n_shingles > 0")
        .groupBy("digest")
        .agg(
            F.min("place").alias("rep"), F.max("n_shingles").alias("n"), F.max("regs").alias("regs"),
            F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n_same"),
            F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "place")).alias("front"),
        )
    )
    bands = _bands(classes, percent)
    hubs = bands.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    # Most keys have one member; only shared ones go on.
    shared = cut_lineage(bands.join(hubs, "key"))
    pairs = shared.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    links = cut_lineage(_confirm(cut_lineage(_filter_pairs(pairs, classes, percent)), packed, percent))
    roots = merge_labels(links)
    # What the likely pairs link need not meet again, nor do members without another plausible pair.
    met = _blocks(shared, roots)
    for likely in (True, False):
        found = cut_lineage(_across(met, classes, percent, likely))
        more = cut_lineage(found.filter("a IS NOT NULL").select("a", "b").distinct())
        if not more.isEmpty():
            new = cut_lineage(_confirm(more, packed, percent))
            if not new.isEmpty():
                links = links.unionByName(new)
                roots = merge_labels(links)
        met = _blocks_left(found, roots)
    placed = classes.select("digest", "rep", "least_id", "front", "n_same").join(
        roots.select(F.col("node").alias("rep"), "root"), "rep", "left"
    ).withColumn("root", F.coalesce("root", "rep"))
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min("front").alias("front"))
    named = placed.drop("front", "least_id").join(least, "root").select("digest", "component_id", F.col("front.place").alias("front"), "n_same")
    alone = F.col("n_shingles") == 0
    return rows.select("place", "doc_id", "n_shingles", "digest").join(named, "digest", "left").select(
        "place", "doc_id", "n_shingles",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"),
        (alone | (F.col("place") == F.col("front"))).alias("chosen"),
        F.when(alone, F.lit(1)).otherwise(F.col("n_same")).cast("bigint").alias("n_same"),
    )


def drop_copies(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each near-duplicate component left."""
    packed = pack(docs, carry=True)
    return select_places(docs, packed, near_duplicates(packed=packed, percent=percent).filter("chosen").select("place"), keep=True)
