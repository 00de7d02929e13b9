"""A corpus pipeline of five stages; every stage works on all that the one before it kept.

quality filter -> exact dedup -> near dedup -> decontamination -> packing. Each stage takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again for the next one. All but the last return the
columns of ``documents``, whatever they are called.

Odd rows: a null text counts as empty in every stage and stays null in the rows that are kept; empty texts are scored,
deduplicated and packed like others. A null id is smaller than any other in exact dedup and larger in near dedup, so it
stays only when its group has no other. Repeated rows (same id and text) are one group in both dedup stages
and separate rows in the others. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusaudit.checks.registry import Query
from corpusaudit.llm import decontamination, exact_dedup, packing, quality_crf, simhash
from corpusaudit.llm.common import kept

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier predicts to be good; it is fitted on the labelled ones among ``docs``."""
    model = quality_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_crf.score(docs, model).filter("predicted = 1").select("row.*")


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the largest id."""
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the smallest id."""
    return simhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_filter),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("decontamination", decontaminate),
    ("packing", pack_sequences),
]

#: The classifier, the fingerprints' hash and the tokenizer cannot be said in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next begins."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def load_queries() -> dict[str, Query]:
    return {"pipeline": Query("pipeline", run, ORACLE_SQL)}
