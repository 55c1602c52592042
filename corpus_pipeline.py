"""A corpus pipeline of five stages, each calling one training-data operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``. All but the last
return the columns of ``documents``; further columns are dropped. Null texts are
empty ones. A table without rows gives one without rows at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.llm.common import scratch_path
from evalframe.llm.mixing import mixed_documents
from evalframe.llm.near_dup import deduplicated
from evalframe.llm.outliers import accepted
from evalframe.llm.packing import pack
from evalframe.llm.secret_scan import redact
from evalframe.llm.tokens import token_count

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go.

    Null and empty texts have no words and go; of repeated rows all stay or all go; very long texts stay whole.
    """
    return accepted(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, that with the least doc_id; of repeated rows one stays."""
    return deduplicated(docs.select(*COLUMNS))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts become marks, and n_chars follows. A null text stays null."""
    return redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many of the tokenizer's tokens as there are, mixed by weights: small leaves come up to three times, large ones in part.

    Weights are square roots of sizes; languages and sources that are null are leaves of their own.
    """
    return mixed_documents(docs.select(*COLUMNS), tokens=token_count(F.col("text")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4,096 tokens; a document that the mix has twice is packed twice, a longer one in pieces."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dup", near_duplicates),
    ("secrets", secrets),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: Robust estimates, similarity classes and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
