import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from brute import water_fill, words

from slidelake.llm import decontaminate, mixing, warc


@pytest.fixture(scope="module")
def sources(prose, odd_rows):
    draw = random.Random(1)
    rows = [(i, prose(i, draw.randrange(1, 60)), "en", f"s{draw.choice([0, 0, 0, 1, 2, 3, 4])}") for i in range(400)]
    return rows + [(1000 + i if i else i, t, a, "long" if len(t or "") > 50_000 else b) for i, t, a, b in odd_rows] + [(2000, "one two", "en", "tiny")]


def test_mix_meets_targets(spark, documents, sources):
    docs = documents(sources).repartition(4)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(sources)
    sizes = {}
    for _, t, _, s in sources:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    targets, taken = water_fill(sizes), {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size) and r.source_size == sizes[r.source]
        assert abs(r.target - targets[r.source]) < 1e-3 * max(1, targets[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        # One document is the whole of a source whose target lies nearer to it than to nothing, or not.
        assert s == "long" or abs(n - targets[s]) <= max(2, 0.05 * targets[s]), s
    again = mixing.mix_sources(docs.repartition(2)).collect()
    key = lambda r: tuple(str(v) for v in r)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_of_nothing(spark, documents):
    assert mixing.mix_sources(documents([])).count() == 0
    got = mixing.mix_sources(documents([(1, None, None, "a"), (2, "", None, None)])).collect()
    assert {(r.size, r.target, r.taken) for r in got} == {(0, 0.0, 0)}


def test_crowded_length_is_drawn_exactly(spark, documents):
    rows = [(i, "a b c", "en", "big") for i in range(3000)] + [(5000 + i, "a b", "en", "small") for i in range(50)]
    got = mixing.mix_sources(documents(rows)).collect()
    big = [r for r in got if r.source == "big"]
    assert abs(sum(r.taken for r in big) - big[0].target) <= 3


def test_budget_is_the_best_sum():
    draw = random.Random(3)
    for k in range(40):
        counts = {draw.randrange(1, 30): draw.randrange(1, 6) for _ in range(draw.randrange(1, 6))}
        total = sum(n * c for n, c in counts.items())
        budget = draw.randrange(0, total + 1)
        take = mixing.fit_budget(dict(counts), budget, k)
        got = sum(n * c for n, c in take.items())
        assert all(0 <= c <= 3 * counts[n] for n, c in take.items())
        sums = {0}
        for n, c in counts.items():
            sums = {x + n * j for x in sums for j in range(c + 1)}
        assert abs(budget - got) <= max(min(abs(budget - x) for x in sums), max(counts) // 2)


@pytest.fixture(scope="module")
def pages(spark):
    long = "<html>" + "ü" * 200
    rows = [
        (4, "http://www.Example.com/a?b=1", long), (2, "https://u@example.com:8080/x#y", long), (9, "http://www.example.com/a?b=1", long),
        (1, None, "short"), (3, "no scheme\twith tab\nand line", "short"), (5, "http://x.org", None), (None, "http://n.org/", long),
        (6, "", ""), (7, "http://y.org/" + "p" * 3000, "z" * 100_000), (8, "http://y.org/", "q" * 100), (11, "http://y.org/", "q" * 100),
        (11, "http://y.org/", "q" * 100), (12, "http://z.org", "r" * 99), (13, "http://z.org", "r" * 99),
    ]
    return rows, spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id bigint, url string, html string, key string, block string")


def test_archives_round_trip(spark, pages):
    rows, table = pages
    got = warc.archive_round_trip(table).collect()
    assert len(got) == len(rows)
    first = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        if i is not None and len(raw) >= 100:
            first[raw] = min(first.get(raw, i), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= 100 and i != first[raw]
        want.append((str(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", str(first[raw]) if again else "None"))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)


def test_lookup_finds_only_what_is_there(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 2)
    monkeypatch.setattr(warc, "PAGE_BLOCKS", 2)
    _, table = pages
    blocks, directory = warc.write_archives(table)
    assert blocks.count() > 3
    wanted = spark.createDataFrame([("com,example,www)/a?b=1 " + "4".zfill(20),), ("aa)/ 1",), ("zz)/ 1",)], "key string")
    assert [r.page_id for r in warc.lookup(wanted, blocks, directory).collect()] == [4]
    assert warc.archive_round_trip(table.limit(0)).count() == 0


@pytest.fixture(scope="module")
def leaks(prose, odd_rows):
    items = [(k, prose(500 + k, 20 + 3 * k, 400).replace(".", ". ")) for k in range(20)] + [(90, None), (91, "too short"), (None, prose(777, 30, 400))]
    rows = []
    for i in range(150):
        text = prose(i, 300 + i, 400)
        if i % 10 == 0:
            w = text.split(" ")
            at = (7 * i) % len(w)
            text = " ".join([*w[:at], items[i // 10 % 20][1].upper() if i % 20 else items[i // 10 % 20][1], *w[at:]])
        rows.append((i, text, "en", "a"))
    rows.append((200, items[3][1].rsplit(" ", len(items[3][1].split()) // 2)[0], "en", "a"))  # half an item is none
    return rows + [(None if i is None else 5000 + i, t, a, b) for i, t, a, b in odd_rows], items


def test_leaks_equal_containment(spark, documents, leaks):
    rows, items = leaks
    table = spark.createDataFrame([(*x, "e") for x in items], "item_id bigint, text string, place string")
    got = decontaminate.decontaminate(documents(rows).repartition(3), table).collect()
    assert len(got) == len(rows)
    for r in got:
        want = [r.doc_id // 10 % 20] if r.doc_id is not None and r.doc_id < 150 and r.doc_id % 10 == 0 else []
        assert r.item_ids == want and r.contaminated == bool(want), r.doc_id
    docs = documents(rows)
    kept = decontaminate.drop_contaminated(docs, table)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 15


def test_several_indexes_and_empty_tables(spark, documents, leaks, monkeypatch):
    rows, items = leaks
    table = spark.createDataFrame(items, "item_id bigint, text string")
    assert decontaminate.decontaminate(documents([]), table).count() == 0
    assert not any(r.contaminated for r in decontaminate.decontaminate(documents(rows[:12]), table.limit(0)).collect())
    monkeypatch.setattr(decontaminate, "INDEX_ITEMS", 6)
    got = decontaminate.decontaminate(documents(rows[:100]), table).collect()
    assert sorted(r.doc_id for r in got if r.contaminated) == list(range(0, 100, 10))


def test_block_bounds_lose_no_item():
    draw = random.Random(8)
    text = lambda n: " ".join(f"t{int(draw.paretovariate(0.6))}" for _ in range(n))
    items = [text(draw.randrange(8, 40)) for _ in range(60)]
    index = decontaminate.Index(list(range(60)), pa.array(items))
    queries = [text(30) + " " + items[k] + " " + text(10) for k in range(60)] + [text(90) for _ in range(40)]
    raw = [q.encode() for q in queries]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
    got = {(d, i) for d, i, *_ in index.search(np.frombuffer(b"".join(raw), np.uint8), offsets)}
    assert {(k, k) for k in range(60)} <= got


def test_short_items_count_as_whole_sequences(spark, documents, prose):
    items = [(k, " ".join(prose(3000 + k, k, 10**6).replace(".", "").split(" "))) for k in range(1, 8)]
    items += [(17, items[6][1].upper() + "?"), (20, prose(3020, 20)), (30, ""), (31, " ?! ")]
    rows = [(0, prose(1, 80), "en", "a"), (100, items[6][1].rsplit(" ", 1)[0], "en", "a"), (101, items[6][1].rsplit(" ", 1)[1], "en", "a")]
    for k, t in items[:7]:
        w = prose(50 + k, 60).split(" ")
        rows.append((k, " ".join([*w[:20], t.upper() + "!", *w[20:], t]), "en", "a"))
        if k > 1:
            rows.append((50 + k, " ".join([*w, *reversed(t.split(" "))]), "en", "a"))  # all words, another order
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(documents(rows).coalesce(1), table).collect()}
    plain = lambda t: f" {' '.join(re.findall('[a-z0-9]+', t.lower()))} "
    for i, t, _, _ in rows:
        want = sorted(k for k, x in items if plain(x).strip() and plain(x) in plain(t))
        assert got[i].item_ids == want and got[i].contaminated == bool(want), i
    assert got[7].item_ids == [7, 17] and got[7].score == 1.0 and not got[100].contaminated
    only = decontaminate.decontaminate(documents(rows), table.filter("item_id = 3")).filter("contaminated").collect()
    assert [r.doc_id for r in only] == [3]


def test_several_indexes_score_like_one(spark, documents, prose, monkeypatch):
    # Copies with every few words changed, near the threshold; a long item sets the passages of all.
    items = [(k, prose(7000 + k, 20 + 2 * k, 60 + 40 * k).replace(".", "")) for k in range(24)] + [(50, prose(7100, 150)), (51, "few words")]
    rows = []
    for k, t in items[:24]:
        for c in range(4):
            w = t.split(" ")
            w[len(w) // 4 : len(w) // 4 + c] = [f"z{j}" for j in range(c)]
            rows.append((10 * k + c, " ".join([prose(k, 200), *w, prose(k + 500, 200)]), "en", "a"))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    read = lambda: {(r.doc_id, tuple(r.item_ids), r.score and round(r.score, 5)) for r in decontaminate.decontaminate(documents(rows), table).collect()}
    one = read()
    monkeypatch.setattr(decontaminate, "INDEX_ITEMS", 6)
    assert read() == one and any(s and s < 0.99 for _, _, s in one)
