"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.llm import conversation_trie, hard_negatives, knn, mixing, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalframe.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalframe.llm.url_filter import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalframe.llm.secret_scan import scan

    return scan(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalframe.llm.mixing import hashed_domains, mix, target_weights

    docs = table(spark, sf_dir, "documents")  # counted in words, which SQL can check; the pipeline counts in tokens
    return mix(docs, weights=target_weights(spark), domains=hashed_domains(docs)).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch", "budget")


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalframe.llm.near_dup import classes

    return classes(table(spark, sf_dir, "documents"))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalframe.llm.knn import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalframe.llm.rollup import maintain

    return maintain(table(spark, sf_dir, "documents"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalframe.llm.quality_model import score

    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalframe.llm.outliers import judge

    return judge(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalframe.llm.suffix_dedup import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"), with_text=True)
    # what is left as text; the halves of a character that a string's end cuts are replaced
    return out.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalframe.llm.conversation_trie import trie

    return trie(spark, table(spark, sf_dir, "conversations"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalframe.llm.chat_format import read_back, windows, with_control_strings

    return read_back(windows(with_control_strings(table(spark, sf_dir, "conversations"))))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalframe.llm.hard_negatives import mine

    return mine(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_url_filter": op2_url_filter,
    "op3_secret_scan": op3_secret_scan,
    "op4_source_mixing": op4_source_mixing,
    "op5_near_dup": op5_near_dup,
    "op6_top_k": op6_top_k,
    "op7_token_rollup": op7_token_rollup,
    "op8_quality_model": op8_quality_model,
    "op9_quality_rules": op9_quality_rules,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_chat_format": op12_chat_format,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": url_filter.oracle_sql(),
    "op4_source_mixing": mixing.oracle_sql(),
    "op6_top_k": knn.oracle_sql(),
    "op11_prefix_trie": conversation_trie.oracle_sql(),
    "op13_hard_negatives": hard_negatives.oracle_sql(),
}
