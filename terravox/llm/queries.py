"""The registered queries of the text operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravox.llm.ann import nearest
from terravox.llm.chat_format import SQL as CHAT_SQL
from terravox.llm.chat_format import perspectives
from terravox.llm.common import table
from terravox.llm.filter_audit import SQL as AUDIT_SQL
from terravox.llm.filter_audit import audit
from terravox.llm.hard_negatives import SQL as NEGATIVES_SQL
from terravox.llm.hard_negatives import mine
from terravox.llm.leak_search import leaks
from terravox.llm.license_scan import scan_licenses
from terravox.llm.secret_scan import scan_secrets
from terravox.llm.simhash import near_duplicates
from terravox.llm.suffix_dedup import repeated_passages
from terravox.llm.token_counts import count_tokens
from terravox.llm.toxicity import judge
from terravox.llm.unigram import encode_texts
from terravox.llm.url_filter import judge_urls, labelled_urls


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op3_approximate_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages, labelled_urls(pages))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("spans")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(spark, table(spark, sf_dir, "documents"), ["doc_id"])


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark, table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    # As the contract asks, every seventh row is given the next label.
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_secret_scan, op2_license_scan, op3_approximate_neighbours, op4_url_filter, op5_toxicity, op6_benchmark_decontamination, op7_chat_perspectives, op8_simhash_near_duplicates, op9_suffix_dedup, op10_sentencepiece, op11_token_counts, op12_filter_audit, op13_hard_negatives)
}
#: DuckDB SQL of the queries that SQL can say.
SQL: dict[str, str] = {"op7_chat_perspectives": CHAT_SQL, "op12_filter_audit": AUDIT_SQL, "op13_hard_negatives": NEGATIVES_SQL}
