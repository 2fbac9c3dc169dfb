import hashlib
import random

import numpy as np
import pytest
from brute import components, repeated_bytes, repeated_words
from pyspark.sql import functions as F

from slidelake.llm import runindex, setsketch, superkmers
from slidelake.llm.batches import pack
from slidelake.operators.skew import shuffled
from slidelake.sources.tilestore import payload_moves


def edited(text, seed, share):
    draw = random.Random(seed)
    return " ".join(f"e{draw.randrange(10**6)}" if draw.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def copies(prose):
    rows, n = [], 100
    for g in range(12):
        base = prose(g, 60 + 40 * g)
        for c in range(6):
            n += 1
            rows.append((n, base if c < 2 else edited(base, 50 * g + c, 0.004 * c), "en", "s"))
    return rows


def near(docs):
    return {(r.place): r for r in setsketch.near_duplicates(docs).collect()}


def test_components_equal_all_pairs(spark, documents, copies, odd_rows):
    rows = [r for r in copies + odd_rows if r[0] is not None]
    roots, sets = components([r[1] for r in rows])
    ids = [r[0] for r in rows]
    least = {}
    for i, c in enumerate(roots):
        least[c] = min(least.get(c, ids[i]), ids[i])
    got = {r.doc_id: r for r in setsketch.near_duplicates(documents(rows)).collect()}
    for i, r in enumerate(rows):
        own = got[r[0]]
        assert (own.n_shingles, own.component_id, own.kept) == (len(sets[i]), least[roots[i]], ids[i] == least[roots[i]])
    assert sum(len({roots[i] for i in range(len(rows)) if roots[i] == c}) for c in set(roots)) < len(rows)


def test_null_and_repeated_ids_of_near_copies(spark, documents, prose):
    text = prose(1, 100)
    rows = [(None, text, "en", "a"), (7, text, "en", "a"), (7, text, "en", "a"), (None, None, None, None)]
    got = setsketch.near_duplicates(documents(rows)).collect()
    assert sorted((r.component_id or -1, r.kept, r.chosen) for r in got) == [
        (-1, True, True), (7, False, False), (7, True, False), (7, True, True),
    ]
    kept = setsketch.drop_copies(documents(rows)).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == [(-1, None), (7, text)] or len(kept) == 2


def test_pairs_across_the_first_member_are_found(spark, documents, prose):
    # A chain: neighbours are linked, the ends are not.
    base = prose(5, 400).split(" ")
    rows = []
    for k in range(6):
        w = list(base)
        for j in range(k):
            w[20 + 60 * j] = f"x{j}"
        rows.append((k, " ".join(w), "en", "a"))
    roots, _ = components([r[1] for r in rows])
    got = {r.doc_id: r.component_id for r in setsketch.near_duplicates(documents(rows)).collect()}
    assert got == dict(enumerate(roots))


def test_linked_members_of_a_crowded_bucket_are_not_copied(spark, monkeypatch):
    """Only what lies outside a bucket's largest component meets every block; it was each member before."""
    monkeypatch.setattr(setsketch, "BLOCK", 10)
    rows = [(r, 0, 5, 0, 400) for r in range(400)] + [(1000 + r, 1, 6, 1000, 40) for r in range(40)]
    shared = spark.createDataFrame(rows, "rep bigint, band int, key bigint, hub bigint, members bigint")
    # Of the first bucket all but six are linked; of the second all are.
    roots = spark.createDataFrame([(r, 0) for r in range(394)] + [(1000 + r, 1000) for r in range(40)], "node bigint, root bigint")
    met = setsketch._blocks(shared, roots).toPandas()
    assert set(met["key"]) == {5} and len(met) <= 394 + 6 * 41
    for outer in range(394, 400):
        blocks = met[met["rep"] == outer][["low", "high"]].merge(met, on=["low", "high"])
        assert set(blocks["rep"]) == set(range(1, 400))


def test_components_do_not_depend_on_the_size_of_blocks(spark, documents, prose, monkeypatch):
    base = prose(9, 300)
    rows = [(i, edited(base, i, 0.004 + 0.002 * (i % 12)), "en", "a") for i in range(60)]
    roots, _ = components([r[1] for r in rows])
    monkeypatch.setattr(setsketch, "BLOCK", 7)
    assert {r.doc_id: r.component_id for r in setsketch.near_duplicates(documents(rows)).collect()} == dict(enumerate(roots))


def test_sketches_merge_and_estimate():
    draw = np.random.default_rng(3)
    a, b = (draw.integers(0, 2**64, 900, np.uint64) for _ in range(2))
    common = draw.integers(0, 2**64, 9000, np.uint64)
    one, two = np.concatenate((common, a[:100])), np.concatenate((common, b[:100]))
    ra, rb = setsketch.registers(one), setsketch.registers(two)
    assert (setsketch.registers(np.concatenate((one, two))) == np.maximum(ra, rb)).all()
    above, below = setsketch._counts(ra, rb)
    n = np.array([9100])
    assert setsketch.plausible(n, n, np.array([above]), np.array([below]))[0]
    far = setsketch.registers(np.concatenate((common[:4500], draw.integers(0, 2**64, 4600, np.uint64))))
    above, below = setsketch._counts(ra, far)
    assert not setsketch.plausible(n, n, np.array([above]), np.array([below]))[0]


def test_repeated_windows_equal_brute_force(spark, documents, copies, odd_rows):
    rows = [r for r in copies + odd_rows if r[0] is not None]
    want = repeated_words([(i, t) for i, t, _, _ in rows])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in superkmers.remove_repeats(documents(rows).repartition(5)).collect()}
    assert got == want
    assert any(0 < v[1] < v[0] for v in want.values())


def test_repeated_windows_of_null_and_repeated_ids(spark, documents, prose):
    text = prose(2, 60)
    rows = [(None, text, "en", "a"), (5, text, "en", "a"), (5, text, "en", "a"), (9, text, "en", "a")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in superkmers.remove_repeats(documents(rows).repartition(3)).collect())
    assert got == [(-1, 60), (5, 0), (5, 0), (9, 60)]


@pytest.mark.parametrize("options", [{}, {"hot_strings": 1, "index_bytes": 500, "gram": 6}])
def test_repeated_strings_equal_brute_force(spark, documents, copies, odd_rows, options):
    rows = [r for r in copies[:30] + odd_rows if r[0] is not None and len(r[1] or "") < 20_000]
    rows.append((900, "ab" * 300, "en", "a"))  # repeats itself, overlapping
    rows.append((901, "Straße für Öl " * 40, "de", "a"))
    length = 60
    raw = [(t or "").encode() for _, t, _, _ in rows]
    masks = repeated_bytes(raw, length)
    got = {r.doc_id: r for r in runindex.remove_repeats(documents(rows).repartition(4), length, **options).collect()}
    for (i, _, _, _), t, m in zip(rows, raw, masks):
        r, kept = got[i], bytes(b for b, g in zip(t, m) if not g)
        spans = sum(g and (k == 0 or not m[k - 1]) for k, g in enumerate(m))
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(t), sum(m), spans)
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_stripping_keeps_columns_and_characters(spark, documents):
    part = "größe über alles süß " * 6
    rows = [(1, "Anfang " + part + "eins", "de", "a"), (None, "ä" + part + "zwei", "de", None), (3, None, None, None), (3, "", "x", "y")]
    docs = documents(rows)
    got = runindex.strip_repeats(docs, 40)
    assert got.columns == docs.columns
    out = {(r.doc_id, r.lang): r for r in got.collect()}
    assert out[(3, None)].text is None and out[(3, "x")].text == ""
    for key, front, back in (((1, "de"), "Anfang", "eins"), ((None, "de"), "ä", "zwei")):
        assert out[key].text.startswith(front) and out[key].text.endswith(back) and out[key].n_chars == len(out[key].text) < 40


def test_matching_statistics_equal_brute_force():
    draw = random.Random(4)
    parts = ["".join(draw.choice("ab") for _ in range(n)) for n in (40, 25, 40, 1, 33)]
    parts.append(parts[0][5:30])
    text = "".join(parts).encode()
    index = runindex.RunIndex(np.frombuffer(text, np.uint8), np.array([len(p) for p in parts]))
    got = index.matching_statistics()
    suffixes, at = [], 0
    for p in parts:
        suffixes += [p[i:] for i in range(len(p))]
    for i, s in enumerate(suffixes):
        want = max(next((k for k in range(min(len(s), len(o))) if s[k] != o[k]), min(len(s), len(o))) for j, o in enumerate(suffixes) if j != i)
        assert got[i] == want
    assert index.runs < len(text)


def test_suffixes_are_sorted_as_numbers(monkeypatch):
    """Sorting places by their keys took most of the index's time; equal suffixes still follow text order."""
    draw = np.random.default_rng(6)
    for letters, sizes in ((1, [40, 40, 7]), (2, [300, 1, 300]), (60, [500, 20]), (256, [700])):
        parts = [draw.integers(0, letters, k).astype(np.uint8) for k in sizes]
        parts.append(parts[0][3:])
        lengths = np.array([len(p) for p in parts])
        with monkeypatch.context() as patch:
            patch.delattr(np, "argsort")
            got = runindex.RunIndex(np.concatenate(parts), lengths)._sort()
        suffixes = [(p[i:].tobytes(), at + i) for p, at in zip(parts, np.cumsum(lengths) - lengths) for i in range(len(p))]
        assert got.tolist() == [at for _, at in sorted(suffixes)]


@pytest.mark.parametrize("operator", [
    lambda d: setsketch.near_duplicates(d), lambda d: superkmers.remove_repeats(d), lambda d: runindex.remove_repeats(d),
    lambda d: runindex.strip_repeats(d), lambda d: setsketch.drop_copies(d),
])
def test_empty_tables(spark, documents, operator):
    assert operator(documents([])).count() == 0


def test_packing_loses_nothing(spark, documents, odd_rows):
    packed = pack(documents(odd_rows).repartition(3), batch_bytes=2000)
    assert packed.agg({"rows": "sum"}).first()[0] == len(odd_rows)


def test_windows_that_share_a_hash_are_told_apart():
    draw = random.Random(8)
    raw = np.frombuffer(" ".join(draw.choice(["a", "b", "cc"]) for _ in range(600)).encode(), np.uint8)
    w = superkmers.Windows(raw, np.array([0, len(raw)]), 5, 2)
    order = (np.zeros(len(w.at), np.int64), w.place)
    true, tied = (superkmers.first_of_equal(raw, w.starts, w.ends, w.at, order, 5, h) for h in (w.hashes, w.hashes % np.uint64(3)))
    seen, late = set(), []
    text = raw.tobytes().decode().split()
    for p in w.place:
        late.append(tuple(text[p : p + 5]) in seen)
        seen.add(tuple(text[p : p + 5]))
    assert 0 < sum(late) < len(late) and list(true) == late and list(tied) == late


def test_cutting_windows_holds_little_beside_the_batch():
    """A reused worker must not need some 100 MB more for every megabyte that it cuts at once."""
    import tracemalloc

    draw = np.random.default_rng(3)
    buf = draw.integers(97, 123, 3 << 20).astype(np.uint8)
    edges = np.arange(0, len(buf) + 1, 4096)
    tracemalloc.start()
    found = runindex.cut(buf, edges[:-1], edges[1:], 256, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert int(found["windows"].sum()) == (len(edges) - 1) * (4096 - 255)
    assert peak < 64 << 20


def test_packed_texts_stay_where_they_are(spark, documents, prose):
    packed = pack(documents([(i, prose(i, 50), "en", "a") for i in range(20)]))
    told = packed.groupBy("batch").agg(F.collect_list("rows").alias("told"))
    for how in ("inner", "left"):
        joined = packed.select("batch", "payload").join(shuffled(told), "batch", how)
        assert payload_moves(joined, "payload") == []
        assert joined.agg(F.sum(F.get("told", F.lit(0)))).first()[0] == 20


def test_a_crowded_block_sends_no_more_pairs_than_members():
    a, b = (x.ravel() for x in np.triu_indices(300, 1))
    weight = (a * 7919 + b * 104729) % 1000
    kept = setsketch._spanning(a, b, weight)
    assert len(kept) == 299
    near = {0}
    for _ in range(300):
        near |= {y for x, y in [*zip(a[kept].tolist(), b[kept].tolist()), *zip(b[kept].tolist(), a[kept].tolist())] if x in near}
    assert near == set(range(300))
    assert weight[kept].min() > np.median(weight)
