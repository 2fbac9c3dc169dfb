import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from slidelake.llm import alignment, hardneg, sharding

# --- Hard negatives ----------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, label int, place string, block string, score string"


def negatives_by_hand(rows, k=5, m=3, low=50, high=95):
    """Plain version over ``(vec_id, embedding, label)``; anchors have ids divisible by 50."""
    good = [
        (i, [int(np.floor(256 * float(np.float32(x)))) for x in v], lab) for i, v, lab in rows
        if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    last = lambda i: (i is None, i or 0)
    out = []
    for n, (a, va, la) in enumerate(good):
        if a is None or a % 50:
            continue
        scored = [(sum(x * y for x, y in zip(va, v)), i, lab) for j, (i, v, lab) in enumerate(good) if j != n]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for p, i, _ in [s for s in scored if s[2] == la][:k]:
            found = [s for s in scored if s[2] != la and low * p <= 100 * s[0] <= high * p][:m]
            out += [(a, i, r, s[1], p, s[0]) for r, s in enumerate(found, 1)]
    return sorted(out, key=str)


def mined(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], VECTORS).repartition(parts)
    got = hardneg.mine_hard_negatives(df, F.col("vec_id") % 50 == 0).collect()
    return sorted((tuple(r) for r in got), key=str)


def test_negatives_equal_brute_force(spark):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + draw.normal(scale=0.8, size=8)).astype(np.float32).tolist(), int(draw.integers(4))) for i in range(700)]
    want = negatives_by_hand(rows)
    assert len(want) > 50 and mined(spark, rows) == want


def test_negatives_with_ties_copies_and_odd_rows(spark):
    draw = random.Random(2)
    # Half of all rows are one vector of one label; few different scores, so ties decide.
    rows = [(i, [1.0, 0.5] if i % 2 else [float(draw.randrange(-1, 3)), float(draw.randrange(3))], 1 if i % 2 else draw.randrange(3)) for i in range(300)]
    rows += [(0, [1.0, 1.0], 1), (0, [1.0, 1.0], 1), (50, [2.0], 0), (100, [], 2), (None, [1.5, 0.5], 1), (None, [1.0, 0.5], 2)]
    rows += [(150, None, 1), (200, [1.0, None], 1), (250, [1.0, float("nan")], 1), (300, [float("inf"), 1.0], 1), (350, [1.0, 1.0], None), (400, [1.0, 2.0, 3.0], 1)]
    assert mined(spark, rows) == negatives_by_hand(rows)


def test_negatives_of_wide_numbers_and_of_nothing(spark):
    draw = random.Random(3)
    rows = [(i * 5, [draw.uniform(-3e5, 3e5) for _ in range(4)], i % 3) for i in range(120)]
    assert mined(spark, rows) == negatives_by_hand(rows)
    assert mined(spark, []) == [] and mined(spark, [(0, [1.0], 1)]) == [] and mined(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    with pytest.raises(Exception, match="too large"):
        mined(spark, [(0, [1e30], 1), (1, [1e30], 1), (2, [1e30], 2)])


# --- Shards ------------------------------------------------------------------------------------


def shards_by_hand(rows, shards=8, seed="interleave"):
    """``(doc_id, text, source)`` rows to (doc_id, size, crc, shard, slot)."""
    facts = []
    for i, t, s in rows:
        raw = (t or "").encode()
        crc = zlib.crc32(raw)
        draw = hashlib.md5(f"{seed}:{'' if i is None else i}:{crc}:{len(raw) + 1}".encode()).hexdigest()
        facts.append((draw, i, len(raw) + 1, crc, s))
    by_source = defaultdict(list)
    for f in sorted(facts, key=lambda f: f[0]):
        by_source[f[4]].append(f)
    order = [((2 * r + 1) / (2 * len(fs)), f[0], s is not None, s or "", f) for s, fs in by_source.items() for r, f in enumerate(fs)]
    order.sort(key=lambda o: o[:4])
    out, slots = [], Counter()
    for at, (*_, f) in enumerate(order):
        shard = at * shards // len(order)
        out.append((f[1], f[2], f[3], shard, slots[shard]))
        slots[shard] += 1
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def mixture(prose, odd_rows):
    draw = random.Random(8)
    rows = [(i, prose(i, draw.randrange(1, 30)), "en", draw.choice(["hot"] * 5 + ["a", "b", "b", "c", "d"])) for i in range(900)]
    return rows + [(5000 + k if i is None and k % 2 else i, t, a, s) for k, (i, t, a, s) in enumerate(odd_rows)]


def test_shards_equal_brute_force(spark, documents, mixture):
    got = sharding.assign_shards(documents(mixture).repartition(5)).collect()
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got), key=str) == shards_by_hand([(i, t, s) for i, t, _, s in mixture])
    assert {r.law for r in got} == {"rows"}
    rows = Counter(r.shard for r in got)
    assert max(rows.values()) - min(rows.values()) <= 1 and len(rows) == 8
    for shard, n in rows.items():
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(n))
    sizes, cells = Counter(r.source for r in got), Counter((r.source, r.shard) for r in got)
    assert all(abs(cells[s, k] - n / 8) <= 2 for s, n in sizes.items() for k in range(8))


def test_shards_of_few_rows(spark, documents):
    assert sharding.assign_shards(documents([])).count() == 0
    for n in (1, 3, 9):
        got = sharding.assign_shards(documents([(1, "a", "en", None)] * n)).collect()
        assert len(got) == n and max(Counter(r.shard for r in got).values()) == -(-n // 8)
        assert all(r.slot < 2 for r in got)


def test_written_shards_hold_all_rows_in_order(spark, documents, mixture, tmp_path):
    docs = documents(mixture).withColumn("slot", F.lit("own")).withColumn("_at", F.lit("own"))
    told = sharding.write_shards(docs, str(tmp_path / "shards"), shards=3).collect()
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == len(mixture) and set(docs.columns) - {"slot"} | {"doc_slot", "slot", "shard"} == set(back.columns)
    got = sorted(((r.doc_id, len((r.text or "").encode()) + 1, r.shard, r.slot) for r in back.collect()), key=str)
    assert got == sorted(((r.doc_id, r["size"], r.shard, r.slot) for r in told), key=str)
    again = sorted(str(tuple(r)) for r in sharding.assign_shards(documents(mixture).repartition(2), 3).collect())
    assert sorted(str(tuple(r)) for r in spark.createDataFrame(told).select(*sharding.assign_shards(documents(mixture), 3).columns).collect()) == again


# --- Alignment ---------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pair():
    with open(alignment.TOKENIZER_A, encoding="utf-8") as a, open(alignment.TOKENIZER_B, "rb") as b:
        return alignment.TokenizerPair(a.read(), b.read()).load()


def align_by_hand(pair, texts):
    """Whole texts, byte ends in sets, pairs in a dictionary."""
    whole = Tokenizer.from_file(alignment.TOKENIZER_A)
    whole.encode_special_tokens = True
    letters = alignment.byte_letters()
    facts, counts = [], Counter()
    for t in texts:
        a = whole.encode(" " + t, add_special_tokens=False).ids if t else []
        b = pair.b.encode(t) if t else []
        ab = [bytes(letters[c] for c in whole.id_to_token(i)) for i in a]
        bb = [bytes([int(pair.b.id_to_piece(i)[3:5], 16)]) if pair.b.is_byte(i) else pair.b.id_to_piece(i).replace("\u2581", " ").encode() for i in b]
        if not t or not b"".join(ab) == b"".join(bb) == (" " + t).encode():
            facts.append(None)
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        common = sorted(set(ends_a) & set(ends_b))
        at_a, at_b = dict(zip(ends_a, a)), dict(zip(ends_b, b))  # no token is empty
        links = [(at_a[e], at_b[e]) for e in common]
        groups, before = [], 0
        for e in common if len(a) < 3000 else []:
            groups.append(",".join(str(x) for x, ex in zip(a, ends_a) if before < ex <= e) + "|" + ",".join(str(x) for x, ex in zip(b, ends_b) if before < ex <= e))
            before = e
        counts.update(links)
        facts.append((len(a), len(b), len(common), links, ";".join(groups)))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for f in facts:
        if f is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((*f[:3], len(f[3]), sum(counts[x] == best[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), f[4]))
    return out, counts


ODD = [
    None, "", " ", "  ", "a", " a", "a  b   c ", "tab\tand\n\n  lines \n", "x\u00a0 y\u2003 z\u3000 w", "<|endoftext|> here <s> </s> <0x41> <unk>",
    "\u00e9t\u00e9 na\u00efve \u4e2d\u6587 \u65e5\u672c\u8a9e \U0001f600\U0001f468\u200d\U0001f469 x\u0301", "don't we'll I'M 12,345.678", "\u2581 block \u2581\u2581x",
    "nul\x00 and \x1c \x85 odd \u180e breaks", "A" * 300 + " " + "ab" * 200, "a" * 50 + " " * 40 + "b", "same words same words same words",
]


def test_alignment_equals_brute_force(spark, documents, pair, prose):
    texts = ODD + [prose(k, 60) for k in range(40)] + [prose(3, 60)] * 4
    ids = [None if k == 3 else k // 2 for k in range(len(texts))]
    docs = documents([(i, t, "en", "s") for i, t in zip(ids, texts)]).repartition(4)
    done = alignment.Alignment(docs)
    want, counts = align_by_hand(pair, texts)
    got = sorted((str(tuple(r)) for r in done.documents().collect()))
    assert got == sorted(str((i, *w)) for i, w in zip(ids, want))
    assert any(w[0] == 0 for t, w in zip(texts, want) if t) and sum(w[4] < w[3] for w in want) > 3
    assert {(r.a_id, r.b_id): r["count"] for r in done.pair_counts().collect()} == counts


def test_alignment_starts_anew_when_full(spark, documents, pair, prose, monkeypatch):
    monkeypatch.setattr(alignment, "KNOWN_CHUNKS", 20)
    monkeypatch.setattr(alignment, "_SLICE_CHARS", 200)
    texts = [prose(k, 40) for k in range(30)] + ["\u2581", prose(7, 2), None]
    want, _ = align_by_hand(pair, texts)
    got = alignment.Alignment(documents(list(zip(range(99), texts, ["en"] * 99, ["s"] * 99)))).documents().collect()
    assert [tuple(r)[1:] for r in sorted(got)] == want


def test_alignment_of_nothing_and_of_a_long_text(spark, documents, pair, prose):
    empty = alignment.Alignment(documents([]))
    assert empty.documents().count() == 0 and empty.pair_counts().count() == 0
    none = alignment.Alignment(documents([(1, None, None, None), (2, "", "en", "s")]))
    assert sorted(tuple(r) for r in none.documents().collect()) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    long = prose(1, 100_000)  # some 500 kB
    got = alignment.Alignment(documents([(1, long, "en", "s")])).documents().first()
    want, _ = align_by_hand(pair, [long])
    assert tuple(got)[1:7] == want[0][:6]


def test_chunks_encode_as_whole_texts(pair, prose):
    def ids(keys):
        fa, na, fb, nb, good = pair.encode(keys)
        return (fa.tolist(), fb.tolist()) if good.all() else None

    assert pair.local
    for t in [t for t in ODD if t] + [prose(1, 50), "a\n b\n\n  c\td ", "x\u200b y \u200b z"]:
        assert ids(pair.chunks([t])[0]) == ids([t]), t
    assert pair.chunks(["a b", " a", "a\n b", "a  b "]) == [["a", "b"], [" a"], ["a\n b"], ["a", " b "]]


def test_quick_encoder_gives_the_same_ids(pair):
    draw = random.Random(4)
    letters = "etaoinshrdlucmfwyp" * 3 + "ETAOIN" + "\u00e9\u00fc\u00f1\u00df" + "0123456789" + ".,;:!?'-_()" + "'s"
    lines = [" ".join("".join(draw.choice(letters) for _ in range(draw.randrange(1, 14))) for _ in range(100)) for _ in range(300)] + [t for t in ODD if t]
    assert pair.quick is not None
    assert [pair.quick.encode_ordinary(t) for t in lines] == [e.ids for e in pair.a.encode_batch(lines, add_special_tokens=False)]


def test_empty_tokens_end_with_their_neighbours():
    class Pair:
        a_bytes, b_bytes = [b" x", b"", b"y"], [b" ", b"x", b"", b" xy"]
        a_sizes, b_sizes = np.array([2, 0, 1]), np.array([1, 1, 0, 3])
        written = [f"{i}{c}" for i in range(3) for c in ",|"] + [f"{i}{c}" for i in range(4) for c in ",;\n"]

    # A: " x", "", "y" and " x"; B: " ", "x", "" , then no way to end with y but the whole; second chunk " ", "x".
    flat = lambda *v: np.array(v, np.int64)
    written, groups, keys, links = alignment.align(flat(0, 1, 0), flat(2, 1), flat(0, 1, 2, 0, 1), flat(3, 2), Pair)
    assert written == ["0,1|0,1,2", "0|0,1"] and groups.tolist() == [1, 1] and links.tolist() == [4, 1]
    assert sorted(keys.tolist()) == sorted((a << 32) | b for a, b in [(0, 1), (0, 2), (1, 1), (1, 2), (0, 1)])


def test_perfect_hash_is_minimal_and_pairs_are_bounded(pair):
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 20_000))
    made = alignment.PerfectHash.build(keys)
    again = alignment.PerfectHash.restore(made.dump())
    assert sorted(again(keys).tolist()) == list(range(len(keys))) and again.size == len(keys)
    assert alignment.PerfectHash.build(keys[:0])(keys[:3]).tolist() == [-1, -1, -1]
    index = alignment.PairIndex([(k, alignment.PerfectHash.build(keys[at]).dump(), keys[at][np.argsort(alignment.PerfectHash.build(keys[at])(keys[at]))].tobytes())
                                 for k, at in alignment.by_bucket(keys)])
    for k, at in alignment.by_bucket(keys):
        assert sorted(index.find(k, keys[at]).tolist()) == list(range(len(at)))
    with pytest.raises(RuntimeError, match="no count"):
        index.find(0, np.array([12345]))
    assert 100_000 < alignment.most_pairs(pair) < 1_000_000
