"""The rasters of the registered queries: two from driver tables, the rest closed forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stencil import densify, with_shape

GT = (500000.0, 1.0, 0.0, 4000000.0, 0.0, -1.0)
NY, NX = 96, 65

_NOISE = "CAST((x * 7 + y * 13) % 17 AS DOUBLE) * CAST(0.01 AS DOUBLE)"
_H = "CAST(0.5 AS DOUBLE) * y + CAST(0.25 AS DOUBLE) * "
_OFF = "greatest(CAST(0 AS DOUBLE), CAST(y - 40 AS DOUBLE)) * CAST(0.375 AS DOUBLE)"
FORMS = {
    "val": f"{_H}abs(x - 32) + {_NOISE}",
    "y": f"{_H}least(abs(CAST(x AS DOUBLE) - (32 - {_OFF})), abs(CAST(x AS DOUBLE) - (32 + {_OFF}))) + {_NOISE}",
    "2b": f"{_H}least(abs(x - 16), abs(x - 48)) + {_NOISE}",
}
"""Elevation by y and x; the text is valid in Spark and in other SQL."""


def formed(spark: SparkSession, name: str) -> DataFrame:
    i = spark.range(NY * NX).select(F.expr(f"CAST(id DIV {NX} AS INT)").alias("y"), F.expr(f"CAST(id % {NX} AS INT)").alias("x"))
    return i.select(F.lit(name).alias("raster_id"), "y", "x", F.expr(FORMS[name]).alias("z"), F.lit(NY).alias("ny"), F.lit(NX).alias("nx"))


def with_holes(spark: SparkSession) -> DataFrame:
    hole = (F.col("x") * 31 + F.col("y") * 17) % 53 == 0
    return formed(spark, "y").withColumn("raster_id", F.lit("nan")).withColumn("z", F.when(~hole, F.col("z")))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.lit("emb").alias("raster_id"), F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "z"))
    return with_shape(e.select("raster_id", "y", "x", F.col("z").cast("double").alias("z")))


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity")
    g = t.groupBy((F.col("l_orderkey") % 64).cast("int").alias("y"), (F.col("l_partkey") % 64).cast("int").alias("x")).agg(F.max("l_quantity").cast("double").alias("z"))
    return densify(g.withColumn("raster_id", F.lit("li"))).select("raster_id", "y", "x", "z", "ny", "nx")
