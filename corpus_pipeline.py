"""Corpus pipeline: language ID, near-duplicate removal, benchmark decontamination, secret masking, source mixing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import decontaminate, jaccard, langid, mixing, secrets
from shelfwise.llm.common import stage


#: Rows of texts that a stage hands to Python at once. The pipeline's stages run one after the other in the same executors,
#: whose workers keep the largest batch they have seen, on both sides of the pipe.
BATCH_ROWS = 1000


def bounded(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS; a session that asks for smaller ones keeps them."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(setting, "10000")) <= BATCH_ROWS:
        spark.conf.set(setting, str(BATCH_ROWS))


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with lang as it was told; texts without letters and unsure guesses go."""
    bounded(spark)
    return langid.keep_identified(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that n-gram Jaccard links form."""
    bounded(spark)
    return jaccard.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets masked."""
    bounded(spark)
    return secrets.redact(docs, model=secrets.fit(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, and how often (copies), so that each source meets its target."""
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified),
    ("jaccard_join", distinct),
    ("decontamination", decontaminated),
    ("secret_scan", masked),
    ("source_mixing", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained network and connected groups are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None
