import os

import pytest
from brute import components, repeated_bytes
from slidelake.llm import toxicity

import __spark_entry__ as contract
import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, documents, prose, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    passage = prose(4242, 90)
    items = [(k, prose(900 + k, 25)) for k in range(5)]
    rows = []
    for i in range(120):
        text = prose(i, 140)
        if i % 4 == 0:
            text += " vilex grobbe."
        if i % 10 == 3:
            text += " " + passage
        if i % 15 == 5:
            text += " " + items[i // 15 % 5][1]
        rows.append((i, text, "en", f"s{i % 3}"))
    rows += [(200 + i, rows[i][1], "en", "s9") for i in range(1, 40, 2)] + [(300, None, None, None), (301, "", "en", "s1")]
    documents(rows, clash=False).write.parquet(os.path.join(folder, "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id bigint, quality int, toxic int").write.parquet(os.path.join(folder, "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(os.path.join(folder, "benchmark.parquet"))
    return folder, rows, items


def test_stages_equal_brute_force(spark, corpus):
    folder, rows, items = corpus
    docs = spark.read.parquet(folder + "/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "minhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "mixing",
    ]
    stages = [f for _, f in corpus_pipeline.STAGES]

    first = stages[0](spark, docs, folder)
    scores = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.train(docs, spark.read.parquet(folder + "/labels.parquet"))).collect()}
    left = [r for r in rows if scores[r[0]] < 0.5]
    assert first.columns == names and sorted(r.doc_id for r in first.collect()) == sorted(r[0] for r in left)
    assert not any(r[0] < 120 and r[0] % 4 == 0 for r in left) and len(left) > 80

    second = stages[1](spark, first, folder)
    roots, sets = components([r[1] for r in left])
    left = [r for i, r in enumerate(left) if roots[i] == i]
    assert second.columns == names and sorted(r.doc_id for r in second.collect()) == sorted(r[0] for r in left)

    third = stages[2](spark, second, folder)
    raw = [(r[1] or "").encode() for r in left]
    masks = repeated_bytes(raw, corpus_pipeline.STRING_BYTES)
    texts = {r[0]: None if r[1] is None else bytes(b for b, g in zip(t, m) if not g).decode() for r, t, m in zip(left, raw, masks)}
    assert third.columns == names and {r.doc_id: r.text for r in third.collect()} == texts
    assert any(any(m) for m in masks)

    fourth = stages[3](spark, third, folder)
    clean = {i for i, t in texts.items() if not any(x in (t or "") for _, x in items)}
    assert fourth.columns == names and {r.doc_id for r in fourth.collect()} == clean and len(clean) < len(texts)

    last = stages[4](spark, fourth, folder).collect()
    assert {r.doc_id for r in last} == clean and sum(r.taken for r in last) > 0


def test_passages_of_51_words_are_stripped(spark, documents, prose):
    passage = " ".join(f"word{k:02d}" for k in range(51))
    rows = [(i, f"{prose(i, 60)} {passage} {prose(100 + i, 60)}", "en", "a") for i in range(4)] + [(9, prose(9, 120), "en", "a")]
    got = {r.doc_id: r.text for r in corpus_pipeline.strip_repeated_strings(spark, documents(rows), "").collect()}
    assert got[9] == rows[-1][1] and all("word25" not in got[i] and got[i].startswith(prose(i, 50)) and got[i].endswith(prose(100 + i, 60)[60:]) for i in range(4))


def test_run_and_registration(spark, corpus):
    folder, _, _ = corpus
    assert corpus_pipeline.run(spark, folder).count() > 50
    names = set(contract.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(contract.oracle_sql()) <= names


def test_near_copies_are_dropped_from_four_fifths(spark, documents, prose):
    rows = []
    for g in range(30):  # similarities from 0.77 to 0.88, by a changed tail
        base = prose(6000 + g, 204).split(" ")
        rows += [(2 * g, " ".join(base), "en", "a"), (2 * g + 1, " ".join(base[: 204 - 12 - g // 2] + [f"y{g}x{k}" for k in range(12 + g // 2)]), "en", "a")]
    roots, sets = components([r[1] for r in rows], percent=80)
    assert len(set(components([r[1] for r in rows], percent=85)[0])) > len(set(roots)) > 30
    left = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, documents(rows), "").collect()}
    assert len(left) == len(set(roots))
    assert {roots[i] for i in left} == set(roots)
