"""A training corpus from raw documents: filter, deduplicate, decontaminate and mix.

Every stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents`` and
works on all that the stage before kept; its result is written and read again.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slidelake.llm import decontaminate, mixing, runindex, setsketch, toxicity
from slidelake.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model trained on ``labels`` does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.train(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets that are similar by 0.8 or more."""
    return setsketch.drop_copies(docs, percent=80)


#: Strings of so many bytes count as repeated; a passage of 51 words of five letters has some 300.
STRING_BYTES = 256


def strip_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of ``STRING_BYTES`` bytes that occur more than once."""
    return runindex.strip_repeats(docs, length=STRING_BYTES)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document."""
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", strip_repeated_strings),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: A learned score decides in the first stage, which SQL cannot say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, starting from ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
