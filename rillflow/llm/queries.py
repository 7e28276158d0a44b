"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact, html, langid, lm, packing, pu, rules, simhash, urltree
from .common import documents


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(documents(spark, sf_dir))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), words=3, tau=3).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(documents(spark, sf_dir))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled by the labels of the document that its URL ends in the number of."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    number = F.regexp_extract(urltree.path_of(F.col("url")), r"/([0-9]{1,18})[^/0-9]*/?$", 1)
    numbered = pages.select("page_id", F.when(number != "", number).cast("long").alias("number"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return urltree.judge(pages, numbered.join(labels, F.col("number") == F.col("doc_id")).select("page_id", "good"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), 2048)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lm_scoring, op2_simhash, op3_bpe, op4_exact_dedup, op5_url_filters, op6_quality_rules,
                            op7_html_extraction, op8_language_id, op9_quality_classifier, op10_packing)}

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')"

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": f"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, {_NORM} AS norm FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS kept,
               sha256(norm) AS text_sha256
        FROM d""",
}
