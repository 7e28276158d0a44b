"""What several operators share: the shared folder, materialisation and skew-proof lookups.

White space is everywhere the six ASCII characters of ``[\\x20\\x09-\\x0D]``, which is
also what ``bytes.split()`` splits on.
"""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components, shared_dir, stored

__all__ = ["components", "documents", "one_text", "released", "local_path", "scratch", "shared_dir", "skewless_left_join", "stored"]

WHITE = ("\t", "\n", "\x0b", "\x0c", "\r")

#: A key counts as hot when it has more than this share of the rows, so there are
#: at most 1 / HOT_SHARE hot keys: the proven bound of what is broadcast for them.
HOT_SHARE = 0.001


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def one_text(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``ids`` (doc_id, unique; a bounded sample) with one text each: of the least hash among rows of that doc_id."""
    names = [c for c in ids.columns if c != "doc_id"]
    known = ids.select(F.col("doc_id").alias("__id"), F.struct(*names).alias("__of")) if names else ids.select(F.col("doc_id").alias("__id"), F.lit(0).alias("__of"))
    mine = docs.select("doc_id", "text").join(F.broadcast(known), docs["doc_id"] == F.col("__id"))
    one = mine.groupBy("__id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "__of")).alias("one"))
    return one.select(F.col("__id").alias("doc_id"), F.col("one.text").alias("text"), *[F.col(f"one.__of.{c}").alias(c) for c in names])


def released(batches):
    """The batches; what Arrow holds free of those before is given back, which a worker kept for later tasks would keep."""
    for b in batches:
        yield b
        pa.default_memory_pool().release_unused()


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def local_path(uri: str) -> str | None:
    """The path of a shared folder that is mounted as files, else None."""
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


def skewless_left_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Left join on keys that are unique in ``right``; any key may hold any share of ``left``.

    ``weight`` is the number of left rows of each right row, ``total`` that of all. Hot keys
    (more than HOT_SHARE of the rows, hence at most 1/HOT_SHARE of them) are broadcast; the
    left rows they answer leave the shuffled join, where a key of their own spreads them.
    ``right`` should be a stored table. Null keys match nothing.
    """
    names = [c for c in right.columns if c not in keys and c != weight]
    limit = max(32.0, total * HOT_SHARE)
    hot = right.filter(F.col(weight) > limit).select(
        *[F.col(k).alias(f"__h_{k}") for k in keys], F.struct(*names).alias("__hot"))
    cold = right.filter(F.col(weight) <= limit).select(
        *[F.col(k).alias(f"__c_{k}") for k in keys], F.lit(0).cast("long").alias("__c_own"), F.struct(*names).alias("__cold"))
    on_hot = [F.col(k) == F.col(f"__h_{k}") for k in keys]
    x = left.join(F.broadcast(hot), on_hot, "left").drop(*[f"__h_{k}" for k in keys])
    # A row that is answered, or that has a null key, must not meet its like in one task. A hash of the row, unlike a random
    # number, sends it to the same task when one is run again.
    salt = F.lit(1) + F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, kind in left.dtypes if "map<" not in kind and "variant" not in kind]), F.lit(1 << 40))
    spread = F.col("__hot").isNotNull() | F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))
    x = x.withColumn("__own", F.when(spread, salt).otherwise(F.lit(0).cast("long")))
    on_cold = [F.coalesce(F.col(k), _zero(left, k)) == F.col(f"__c_{k}") for k in keys] + [F.col("__own") == F.col("__c_own")]
    x = x.join(cold, on_cold, "left")
    got = F.coalesce(F.col("__hot"), F.col("__cold"))
    return x.select(*left.columns, *[got[n].alias(n) for n in names])


def _zero(df: DataFrame, k: str) -> Column:
    return F.lit("" if dict(df.dtypes)[k] == "string" else 0).cast(dict(df.dtypes)[k])
