"""Mixing sources to target weights by exact budget fitting.

Documents are counted by exact token length; what whole passes over a source
leave of its budget is filled by a proportional share of every length, a seeded
fill and a bounded-knapsack bit set over the lengths left.  Documents of a
length are then picked by a seeded hash.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slidelake.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
SEED = 20
#: Budget that is left to the knapsack; it also bounds the knapsack's bit sets.
KNAPSACK_WORDS = 8192
_SLICE_ROWS = 512


def source_targets(totals: pd.DataFrame, weights: Sequence[float], max_repeats: int) -> pd.DataFrame:
    """Words to take from each source: shares by weight, capped, the excess shared anew.

    ``totals(source, source_size)`` has one row per source; sources rank by code
    point, null last, and take the weights in turn.
    """
    out = totals.sort_values("source", key=lambda s: s.map(lambda v: (v is None or v != v, "" if v is None or v != v else v))).reset_index(drop=True)
    weight = [weights[i % len(weights)] for i in range(len(out))]
    caps = [max_repeats * int(n) for n in out["source_size"]]
    target = [0.0] * len(out)
    rest, active = float(out["source_size"].sum()), set(range(len(out)))
    while active:
        unit = rest / sum(weight[i] for i in active)
        full = [i for i in sorted(active) if unit * weight[i] > caps[i]]
        if not full:
            for i in active:
                target[i] = unit * weight[i]
            break
        for i in full:
            target[i] = float(caps[i])
            rest -= caps[i]
            active.remove(i)
    out["target"] = target
    return out


def fit_budget(counts: dict[int, int], budget: int, seed: int, max_repeats: int = MAX_REPEATS) -> dict[int, int]:
    """How many documents of each length to take, repeats counted, so that the lengths sum to the budget.

    Whole passes come first, then a proportional share of every length, a seeded
    fill and the knapsack, all within one more pass; what is left after that may
    repeat documents up to ``max_repeats`` times.  Where the budget cannot be
    met, the nearer of the sums below and one document above is taken.
    """
    lengths = sorted(n for n in counts if n > 0)
    total = sum(n * counts[n] for n in lengths)
    if not total or budget <= 0:
        return dict.fromkeys(lengths, 0)
    passes = min(max_repeats, budget // total)
    rest = budget - passes * total
    take = {n: counts[n] * passes for n in lengths}
    if passes == max_repeats:
        return take
    for n in lengths:
        share = counts[n] * (budget - passes * total) // total
        take[n] += share
        rest -= share * n
    order = lengths[:]
    random.Random(seed).shuffle(order)
    for most in sorted({passes + 1, max_repeats}):
        rest = _fill(counts, take, rest, order, most)
        if not rest:
            return take
    above = min((n for n in lengths if rest < n < 2 * rest and take[n] < max_repeats * counts[n]), default=None)
    if above:
        take[above] += 1
    return take


def _fill(counts: dict[int, int], take: dict[int, int], rest: int, order: list[int], most: int) -> int:
    """Add documents, each at most ``most`` times, to come closest to ``rest`` from below; returns what is left."""
    while rest > KNAPSACK_WORDS:
        before = rest
        for n in order:
            add = min(most * counts[n] - take[n], 1, (rest - KNAPSACK_WORDS // 2) // n)
            if add > 0:
                take[n] += add
                rest -= n * add
        if rest == before:
            break
    # Bit i of reach: sum i can be made; one bit set per item tells the way back.
    limit = min(rest, sum(n * (most * counts[n] - take[n]) for n in order))
    mask, reach, steps = (1 << (limit + 1)) - 1, 1, []
    for n in order:
        left, chunk = min(most * counts[n] - take[n], limit // n), 1
        while left > 0:
            chunk = min(chunk, left)
            steps.append((n, chunk, reach))
            reach |= (reach << (n * chunk)) & mask
            left -= chunk
            chunk *= 2
        if reach >> limit & 1:
            break
    made = at = reach.bit_length() - 1
    for n, chunk, before in reversed(steps):
        if not before >> at & 1:
            take[n] += chunk
            at -= n * chunk
    return rest - made


def mix_sources(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS, seed: int = SEED
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` for every row of ``docs(doc_id, text, source, ...)``.

    A null or empty text has size 0 and takes nothing; a null source is a source
    of its own, ranked last; an empty table gives no row; other columns are
    ignored.  Rows with equal id, text and source are drawn as separate documents.
    Ties are settled by a seeded hash of id and text, so a rerun picks the same.
    One row per source and one per source and length go through a task.
    """
    sizes = cut_lineage(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
            F.xxhash64(F.lit(seed), F.col("doc_id").cast("bigint"), F.col("text").cast("string")).alias("_draw"),
        )
    )
    lengths = cut_lineage(sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    totals = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))

    def targets(pdf: pd.DataFrame) -> pd.DataFrame:
        return source_targets(pdf, weights, max_repeats)[["source", "source_size", "target"]]

    wanted = totals.withColumn("_all", F.lit(True)).groupBy("_all").applyInPandas(targets, "source string, source_size bigint, target double")
    plan = lengths.alias("l").join(wanted.alias("w"), F.col("l.source").eqNullSafe(F.col("w.source"))).select(
        "l.source", "l.size", "l.n", "w.source_size", "w.target"
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        count = dict(zip(pdf["size"].tolist(), pdf["n"].tolist()))
        take = fit_budget(count, round(float(pdf["target"].iloc[0])), seed, max_repeats)
        full = [take.get(n, 0) // c for n, c in count.items()]
        return pdf.assign(full=full, extra=[take.get(n, 0) - f * c for (n, c), f in zip(count.items(), full)])

    plan = cut_lineage(
        plan.groupBy("source").applyInPandas(
            fit, "source string, size bigint, n bigint, source_size bigint, target double, full bigint, extra bigint"
        )
    )
    drawn = (
        sizes.alias("d")
        .join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size")))
        .select("d.doc_id", "d.source", "d.size", "d._draw", "p.n", "p.source_size", "p.target", "p.full", "p.extra")
    )
    # The draw order of a length is cut into slices of some hundred documents, so that no window holds a crowded length.
    unit = F.shiftrightunsigned("_draw", 33)
    slices = F.ceil(F.col("n") / F.lit(_SLICE_ROWS)).cast("bigint")
    drawn = drawn.withColumn("_slice", F.shiftright(unit * slices, 31).cast("bigint"))
    key = ["source", "size", "_slice"]
    inside = Window.partitionBy(*key).orderBy("_draw", "doc_id")
    open_rows = drawn.filter((F.col("extra") > 0) & (F.col("extra") < F.col("n")))
    before = open_rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("source", "size").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(*key, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    ranked = open_rows.withColumn("_rank", F.row_number().over(inside)).alias("r").join(
        before.alias("b"),
        F.col("r.source").eqNullSafe(F.col("b.source"))
        & (F.col("r.size") == F.col("b.size"))
        & (F.col("r._slice") == F.col("b._slice")),
    )
    picked = ranked.select(
        "r.doc_id", "r.source", "r.size", "r.source_size", "r.target", "r.full",
        (F.col("b._before") + F.col("r._rank") <= F.col("r.extra")).cast("bigint").alias("more"),
    )
    settled = drawn.filter((F.col("extra") <= 0) | (F.col("extra") >= F.col("n"))).select(
        "doc_id", "source", "size", "source_size", "target", "full", (F.col("extra") > 0).cast("bigint").alias("more")
    )
    return picked.unionByName(settled).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("full") + F.col("more"))).alias("taken")
    )
