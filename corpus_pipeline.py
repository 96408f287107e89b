"""From raw documents to a mixed training corpus, in five stages; each is written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerops.llm import decontaminate, langid, mixing, ngram_join, secrets
from ledgerops.llm.tables import written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language the model cannot tell at all, go."""
    return langid.with_known_language(docs)


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the least id stays."""
    return ngram_join.one_of_each_group(docs)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten words in a row, or a whole shorter item, with the benchmark go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def no_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text. All documents stay."""
    return secrets.redact(docs, count_col="n_chars")


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, ordered within its shards."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", known_language),
    ("ngram_jaccard_join", no_near_duplicates),
    ("benchmark_decontamination", no_benchmark),
    ("secret_scan", no_secrets),
    ("mixing", target_mix),
]

#: The joins of word sets, the learnt model and the drawn blocks have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
