"""One query per operator, over its whole table, with checking SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slidelake.llm import (
    alignment, attention, decontaminate, hardneg, language, mixing, quality, runindex, setsketch, sharding, superkmers, toxicity, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if oracle:
            ORACLES[name] = oracle
        return build

    return register


@query("op3_mix_sources")
def mix(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query(
    "op5_warc_index",
    """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS first
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first < page_id THEN first END AS refers_to
FROM f
""",
)
def archives(spark, sf_dir):
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op2_toxicity")
def toxic(spark, sf_dir):
    found = toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


@query("op7_quality_rules")
def quality_rules(spark, sf_dir):
    found = quality.filter_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )


@query("op6_language")
def languages(spark, sf_dir):
    return language.detect(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


@query(
    "op4_superkmer_dedup",
    r"""
WITH x AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p, len(w) AS n_words
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
  WHERE len(w) > 0
), s AS (
  SELECT doc_id, p, n_words,
    string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS seq
  FROM x
), k AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY seq ORDER BY doc_id, p) AS n FROM s WHERE p + 19 <= n_words
), m AS (
  SELECT x.doc_id, x.p, x.word, x.n_words,
    max(CASE WHEN k.n > 1 THEN x.p END) OVER (PARTITION BY x.doc_id ORDER BY x.p) AS last
  FROM x LEFT JOIN k USING (doc_id, p)
), r AS (
  SELECT doc_id, n_words, count(*) FILTER (p - last < 20) AS n_removed,
    string_agg(word, ' ' ORDER BY p) FILTER (last IS NULL OR p - last >= 20) AS kept
  FROM m GROUP BY doc_id, n_words
)
SELECT d.doc_id, coalesce(r.n_words, 0) AS n_words, coalesce(r.n_removed, 0) AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN r USING (doc_id)
""",
)
def repeated_words(spark, sf_dir):
    found = superkmers.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query(
    "op9_run_index_dedup",
    r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), s AS (
  SELECT doc_id, p, n, h, CASE WHEN p + 399 <= n THEN md5(substring(h, 2 * p - 1, 800)) END AS k
  FROM (SELECT doc_id, n, h, unnest(range(1, n + 1)) AS p FROM d)
), w AS (
  SELECT doc_id, p, n, CASE WHEN k IS NOT NULL AND count(*) OVER (PARTITION BY k) > 1 THEN p END AS again FROM s
), c AS (
  SELECT doc_id, p, n, coalesce(p - max(again) OVER (PARTITION BY doc_id ORDER BY p) < 400, false) AS gone FROM w
), r AS (
  SELECT doc_id, gone, min(p) AS a, max(p) AS z FROM (
    SELECT doc_id, p, gone, p - row_number() OVER (PARTITION BY doc_id, gone ORDER BY p) AS island FROM c)
  GROUP BY doc_id, gone, island
), t AS (
  SELECT r.doc_id, coalesce(sum(z - a + 1) FILTER (gone), 0)::BIGINT AS n_removed, count(*) FILTER (gone) AS n_spans,
    coalesce(string_agg(substring(h, 2 * a - 1, 2 * (z - a + 1)), '' ORDER BY a) FILTER (NOT gone), '') AS kept
  FROM r JOIN d USING (doc_id) GROUP BY r.doc_id
)
SELECT d.doc_id, d.n AS n_bytes, coalesce(t.n_removed, 0) AS n_removed, coalesce(t.n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(t.kept, ''))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
""",
)
def repeated_bytes(spark, sf_dir):
    return runindex.remove_repeats(table(spark, sf_dir, "documents"))


@query(
    "op1_setsketch_dedup",
    r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g
  FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN c ON c.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
)
def near_copies(spark, sf_dir):
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


@query("op10_bm25_decontaminate")
def leaks(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_attention_lm")
def language_model(spark, sf_dir):
    return attention.score_documents(table(spark, sf_dir, "documents"))


@query(
    "op11_hard_negatives",
    """
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT a.k AS anchor, a.vec_id AS anchor_id, b.k, b.vec_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.k <> b.k WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor, anchor_id, k AS positive, vec_id AS positive_id, score AS positive_score
  FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER w::INT AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor, positive ORDER BY s.score DESC, s.vec_id)
QUALIFY rank <= 3
""",
)
def hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine_hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 50 == 0)


@query(
    "op12_stratified_shards",
    """
WITH t AS (
  SELECT list(c ORDER BY i) AS tab FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
    FROM range(256) r(i))
), m AS (
  SELECT list(z ORDER BY j, i) AS jump FROM (
    SELECT j, i, list_reduce(list_prepend(i << (8 * j), range(256)), lambda c, k: xor(c >> 8, tab[(c & 255) + 1])) AS z
    FROM range(256) r(i), range(4) s(j), t)
), d AS (
  SELECT row_number() OVER () AS k, doc_id, source, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n
  FROM documents
), p AS (SELECT k, n, unnest(range(n // 256 + 1)) AS part, h FROM d),
q AS (
  SELECT k, part, CASE WHEN part = 0 THEN substring(h, 1, 2 * (n % 256)) ELSE substring(h, 2 * (n % 256) + 512 * (part - 1) + 1, 512) END AS piece
  FROM p
), r AS (
  SELECT k, list(list_reduce(
      list_prepend(CASE WHEN part = 0 THEN 4294967295 ELSE 0 END,
        list_transform(range(len(piece) // 2), lambda i: ('0x' || substring(piece, 2 * i + 1, 2))::BIGINT)),
      lambda c, y: xor(c >> 8, tab[(xor(c, y) & 255) + 1])) ORDER BY part) AS sums
  FROM q, t GROUP BY k
), x AS (
  SELECT k, doc_id, source, (n + 1)::BIGINT AS size, xor(4294967295, list_reduce(sums, lambda c, y:
    xor(y, xor(xor(jump[(c & 255) + 1], jump[(c >> 8 & 255) + 257]), xor(jump[(c >> 16 & 255) + 513], jump[(c >> 24) + 769])))))::BIGINT AS text_crc32
  FROM d JOIN r USING (k), m
), y AS (
  SELECT *, md5('interleave:' || coalesce(doc_id::VARCHAR, '') || ':' || text_crc32 || ':' || size) AS draw FROM x
), z AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY draw, k) - 1) / (2 * count(*) OVER (PARTITION BY source)) AS place FROM y
), o AS (
  SELECT *, row_number() OVER (ORDER BY place, draw, source NULLS FIRST, k) - 1 AS pos, count(*) OVER () AS total FROM z
)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 8 // total)::INT AS shard,
  (pos - (pos * 8 // total * total + 7) // 8)::BIGINT AS slot, NULL::INT AS grown_shard
FROM o
""",
)
def shards(spark, sf_dir):
    found = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=8)
    return found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op13_tokenizer_alignment")
def tokenizer_alignment(spark, sf_dir):
    found = alignment.Alignment(table(spark, sf_dir, "documents")).documents()
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(F.lit(""))
    return found.withColumn("groups_sha256", digest).drop("groups")
