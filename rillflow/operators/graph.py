"""Materialisation and the two graph algorithms the raster operators need: components and pointer doubling."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``. Only a local master has one by default."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "/tmp/checkpoints/rillflow"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage is cut and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no plan still to run refers to."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (a, b); root: the least node of the component.

    Alternating large-star and small-star steps; edges never grow in number and each round is stored.
    """
    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "cc")
    was = mark(e)
    for _ in range(rounds):
        if not was[0]:
            break
        both = e.union(e.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = stored(both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "cc")
        small = large.join(large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), F.col("a") == F.col("u"))
        old, e = e, stored(small.select("a", F.col("m").alias("b")).union(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct(), "cc")
        discard(old, large)
        now = mark(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not converge")
    heads = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(heads)


def accumulate(pointers: DataFrame, rounds: int = 64) -> DataFrame:
    """Upstream counts and roots of a forest by pointer doubling.

    pointers: raster_id, id, ptr (the next id downstream, null at a root). Returns raster_id, id, acc
    (nodes upstream, itself included) and root, after log2 of the longest path rounds.
    """
    s = stored(pointers.select("raster_id", "id", "ptr", F.lit(1).cast("long").alias("acc"), F.coalesce("ptr", "id").alias("root")), "flow")
    for _ in range(rounds):
        if s.filter("ptr is not null").limit(1).count() == 0:
            break
        more = s.filter("ptr is not null").groupBy("raster_id", F.col("ptr").alias("id")).agg(F.sum("acc").alias("more"))
        far = s.select("raster_id", F.col("id").alias("root"), F.col("ptr").alias("next"), F.col("root").alias("far"))
        x = s.join(far, ["raster_id", "root"], "left").join(more, ["raster_id", "id"], "left")
        old, s = s, stored(x.select("raster_id", "id", F.when(F.col("ptr").isNotNull(), F.col("next")).alias("ptr"),
                                    (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc"), F.coalesce("far", "root").alias("root")), "flow")
        discard(old)
    else:
        raise ValueError("the pointers hold a cycle")
    return s.select("raster_id", "id", "acc", "root")
