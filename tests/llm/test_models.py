import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import LOW, base_counts, words
from pyspark.sql import functions as F

from slidelake.llm import attention, language, quality, toxicity

BAD = ["vilex", "grobbe", "scumra"]


@pytest.fixture(scope="module")
def judged(spark, prose):
    """300 texts of which a third has one bad word in one sentence; labels for most."""
    rows, labels = [], []
    for i in range(300):
        text = prose(i, 150, 300)
        if i % 3 == 0:
            w = text.split(" ")
            w[i % 140] = BAD[i % 9 // 3]
            text = " ".join(w)
        rows.append((i, text, "en", "a"))
        labels.append((i, 1, int(i % 3 == 0)))
    labels += [(None, 1, 1), (5, None, None), (4, 1, 0), (999_999, 0, 1)]
    return rows, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxic_sentences_are_found_from_document_labels(spark, documents, judged, odd_rows):
    rows, labels = judged
    odd = [(None if i is None else 5000 + i, t, a, b) for i, t, a, b in odd_rows]
    got = toxicity.detect(documents(rows + odd), labels).collect()
    assert len(got) == len(rows) + len(odd)
    right = held = 0
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        if r.doc_id is not None and r.doc_id < 300 and r.held_out:
            held += 1
            right += r.predicted == int(r.doc_id % 3 == 0)
            if r.predicted and r.doc_id % 3 == 0:
                raw = rows[r.doc_id][1].encode()
                assert any(b.encode() in raw[s.begin : s.end] for s in r.sentences for b in BAD)
    assert right >= 0.9 * held
    by = {r.doc_id: r for r in got}
    assert by[5001].score == by[5002].score == 0.0


def test_no_labels_and_no_documents(spark, documents, judged):
    rows, labels = judged
    none = labels.limit(0)
    assert {r.predicted for r in toxicity.detect(documents(rows[:5]), none).collect()} == {0}
    assert toxicity.detect(documents([]), labels).count() == 0
    assert {r.kept for r in quality.filter_quality(documents(rows[:5]), none).collect()} == {True}
    assert quality.filter_quality(documents([]), labels).count() == 0
    assert language.detect(documents([])).count() == 0
    assert attention.score_documents(documents([])).count() == 0


def test_dropping_toxic_rows_keeps_columns(spark, documents, judged):
    rows, labels = judged
    docs = documents(rows + [(None, None, None, None)])
    kept = toxicity.drop_toxic(docs, toxicity.train(docs, labels))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert None in ids and len({i for i in ids if i is not None and i % 3}) == 200 and len([i for i in ids if i is not None and i % 3 == 0]) < 10


def test_quality_counts_equal_brute_force(spark, documents, prose, odd_rows):
    rows, labels = [], []
    for i in range(120):
        text = prose(i, 80)
        if i % 2:
            text = " ".join(w + "***" for w in text.split(" "))
        rows.append((i, text + ("\nline a\nline a\n\n\nline a" if i % 5 == 0 else ""), "en", "a"))
        labels.append((i, int(i % 2 == 0), 0))
    rows += [(1000, "a b c a b c\nx\n\nx\n", "en", "a"), (1001, "\n\n \n \n", "en", "a"), (1002, "ß ß\r\nß ß\r\n", "de", "a")]
    rows += [(None if i is None else 5000 + i, t, a, b) for i, t, a, b in odd_rows]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = quality.filter_quality(documents(rows), table).collect()
    texts = dict((i, t) for i, t, _, _ in rows if i is not None)
    assert len(got) == len(rows)
    right = 0
    for r in got:
        if r.doc_id is None:
            continue
        counts = base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts, r.doc_id
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.base_failed and r.kept)
        right += r.doc_id < 120 and r.kept == (r.doc_id % 2 == 0)
    assert right >= 110


def speech(seed, n, alphabet):
    draw = np.random.default_rng(seed)
    return " ".join("".join(draw.choice(list(alphabet), draw.integers(2, 8))) for _ in range(n))


def test_languages_and_spans(spark, documents, odd_rows):
    sets = {"aa": "abcde", "bb": "efghi", "cc": "абвгд"}
    rows = [(i, speech(i, 60, s), k, "x") for i, (k, s) in enumerate(list(sets.items()) * 40)]
    mixed = speech(7001, 40, "abcde") + ". " + speech(7002, 80, "efghi")
    rows += [(7000, mixed, None, "x"), (7001, "12 34", "aa", "x"), (7002, "Ω", None, "x"), (7003, "— …", None, "x")]
    rows += [(None if i is None else 8000 + i, t, None, b) for i, t, _, b in odd_rows]
    got = {r.doc_id: r for r in language.detect(documents(rows)).collect() if r.doc_id is not None}
    held = [r for r in got.values() if r.held_out and r.doc_id < 120]
    assert held and all(r.lang_pred == rows[r.doc_id][2] and 0.9 < r.score <= 1 for r in held)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and not got[i].spans for i in (7001, 7003, 8001, 8002, 8003, 8012))
    assert got[7002].lang_pred != "und"  # a letter, though of no learned script
    spans = [(s.lang, mixed.encode()[s.begin : s.end].decode()) for s in got[7000].spans]
    assert [s[0] for s in spans] == ["aa", "bb"] and got[7000].lang_pred == "bb"
    assert abs(len(spans[0][1].split()) - 40) <= 1
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_viterbi_equals_all_paths():
    draw = np.random.default_rng(1)
    count = np.array([5, 0, 3, 1])
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    scores = draw.standard_normal((9, 3)) * 2
    got = language.viterbi(scores, first, count, 1.5)
    import itertools

    def value(path, s):
        return sum(s[i, p] for i, p in enumerate(path)) - 1.5 * sum(a != b for a, b in zip(path, path[1:]))

    for a, n in zip(first, count):
        if n:
            best = max(value(p, scores[a : a + n]) for p in itertools.product(range(3), repeat=int(n)))
            assert abs(value(got[a : a + n], scores[a : a + n]) - best) < 1e-9


def test_unigram_scores_equal_brute_force(spark, documents, prose, odd_rows):
    rows = [(i, prose(i, 120, 200), "en", "a") for i in range(60)]
    rows += [(None if i is None else 5000 + i, t, a, b) for i, t, a, b in odd_rows]
    got = attention.score_documents(documents(rows).repartition(3)).collect()
    tokens = [(i, [w for w in words((t or "").translate(LOW))] + [None]) for i, t, _, _ in rows]
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    count = Counter(w for i, t in tokens if train(i) for w in t)
    total, kinds = sum(count.values()), len(count)
    want = {i: (len(t), sum(count[w] > 0 for w in t), sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t)) for i, t in tokens}
    assert len(got) == len(rows)
    for r in got:
        assert r.train_tokens == total and r.score < 0 and math.isfinite(r.score) and r.held_out == (not train(r.doc_id))
        if r.doc_id is not None:
            n, known, base = want[r.doc_id]
            assert (r.n_tokens, r.n_known) == (n, known) and abs(r.base_score - base) < 1e-6 * abs(base)


def small_model(seed=0):
    leaf, _ = attention.leaf_table(np.arange(500), 10)
    weights = attention.start_model(np.arange(500), 10, leaf)
    draw = np.random.default_rng(seed)
    return attention.Attention({k: (a + draw.standard_normal(a.shape) * 0.2).astype(np.float32) for k, a in weights.items()})


def test_attention_is_a_causal_distribution_over_windows():
    model, draw = small_model(), np.random.default_rng(2)
    x = draw.integers(0, 500, 100)
    doc = np.repeat([0, 1], [70, 30])
    y = draw.integers(0, attention.LEAVES, 100)
    base = model.score(x, y, doc)
    assert np.allclose(model.run(x, y, doc)[0], base, atol=1e-4)
    total = sum(np.exp(model.score(x[:3], np.full(3, k), doc[:3])) for k in range(attention.LEAVES))
    assert np.allclose(total, 1, atol=1e-3)
    later = x.copy()
    later[50:] = 1
    assert np.allclose(model.score(later, y, doc)[:50], base[:50], atol=1e-5)
    # Parts that overlap by one window give what one pass gives.
    step = attention.STEP
    parts = np.concatenate((model.score(x[:64], y[:64], doc[:64]), model.score(x[64 - step :], y[64 - step :], doc[64 - step :])[step:]))
    assert np.allclose(parts, base, atol=1e-4)


def test_gradients_equal_differences():
    model, draw = small_model(1), np.random.default_rng(3)
    model.w = {k: a.astype(np.float64) for k, a in model.w.items()}
    model.tables()
    x, y, doc = draw.integers(0, 500, 45), draw.integers(0, 500, 45), np.repeat([0, 1], [25, 20])
    _, grad = model.run(x, y, doc)
    for name in model.w:
        flat, g = model.w[name].reshape(-1), grad[name].reshape(-1)
        i = int(np.argmax(np.abs(g)))
        keep, e = flat[i], 1e-4
        sums = []
        for step in (e, -e):
            flat[i] = keep + step
            model.tables()
            sums.append(model.run(x, y, doc)[0].sum())
        flat[i] = keep
        model.tables()
        assert abs(-(sums[0] - sums[1]) / (2 * e) / 45 - g[i]) < 2e-3 * max(1, abs(g[i])), name


def test_training_lowers_the_loss(spark):
    model, draw = small_model(), np.random.default_rng(5)
    x = np.tile(np.arange(40), 200)
    y = np.roll(x, -1)
    doc = np.zeros(len(x), np.int64)
    before = model.score(x, y, doc).mean()
    attention.learn(model, iter([(x, y, doc)] * 3), 0.02)
    assert model.score(x, y, doc).mean() > before + 1
    assert F is not None


def test_every_training_document_trains_the_attention_model(spark):
    ranks = attention.read_ranks()
    size, coder = max(ranks.values()) + 1, attention.Coder(ranks)
    pieces = [w for w in (p[1:] for p in sorted(ranks) if p[:1] == b" ") if len(w) > 3 and w.isalpha() and w.islower()][:80]
    train = np.arange(len(pieces)) % 10 != 0
    payloads, inputs = [], []
    for batch in range(4):  # one word of its own for each document
        own = slice(20 * batch, 20 * batch + 20)
        texts = [b" ".join([w] * 5) for w in pieces[own]]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        ids = pa.array(range(own.start, own.stop), pa.int64())
        payloads.append(attention._encode(batch, ids, train[own], np.frombuffer(b"".join(texts), np.uint8), offsets, coder, 2, size)[0][2])
        inputs += [coder([w])[0][0] for w in pieces[own]]
    counts = sum(attention.Told(p).counts for p in payloads)
    leaf, _ = attention.leaf_table(counts, int(train.sum()))
    begin = attention.start_model(counts, int(train.sum()), leaf)
    own = spark.createDataFrame(list(enumerate(payloads)), "batch bigint, payload binary").repartition(2)
    got = attention.train_model(own, {k: a.copy() for k, a in begin.items()}, leaf)
    moved = np.abs(got["embed"] - begin["embed"]).max(axis=1) > 1e-3
    assert len(set(leaf[inputs])) == len(inputs) and (moved[leaf[inputs]] == train).all()
