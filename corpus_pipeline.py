"""From raw documents to packed sequences: five stages, each stored before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillflow.llm import exact, jaccard, langid, packing, rules
from rillflow.llm.common import documents, stored
from rillflow.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the learned list go."""
    return rules.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no learned language stands out go."""
    return langid.keep_known(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that agree but for white space, the longest stays, then the least doc_id."""
    return exact.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by a Jaccard similarity of 0.8 or more over five-word shingles, the least doc_id stays."""
    return jaccard.drop_near_duplicates(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The placement of every piece of every document in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), 2048)


STAGES = [("quality_rules", quality_rules), ("language_id", language_id), ("exact_dedup", exact_dedup),
          ("near_dedup", near_dedup), ("best_fit_packing", best_fit_packing)]

#: Learned models and a tokenizer decide, which SQL cannot express; tests/llm holds the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
