"""Cell tables and vector output: Parquet layers, WKT points and lines, outlet and stream CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.algebra import map_x, map_y


def read_layers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_layers(cells: DataFrame, path: str, rows: int = 1024) -> None:
    """All layers as one Parquet table, partitioned by raster and strip of rows, so that readers prune both."""
    cells.withColumn("strip", F.floor(F.col("y") / rows).cast("int")).repartition("raster_id", "strip").sortWithinPartitions("y", "x").write.mode("overwrite").partitionBy("raster_id", "strip").parquet(path)


def heads_from(cells: DataFrame, c: str = "z") -> DataFrame:
    """Predefined channel heads: the cells whose value is 1."""
    return cells.filter(F.col(c) == 1).select("raster_id", "y", "x")


def point_features(points: DataFrame, kind: str, gt: tuple[float, ...]) -> DataFrame:
    """raster_id, type, x_proj, y_proj, geometry (WKT) of each point."""
    p = points.withColumn("x_proj", map_x(F.col("x"), gt[0], gt[1])).withColumn("y_proj", map_y(F.col("y"), gt[3], gt[5]))
    return p.select("raster_id", F.lit(kind).alias("type"), "x_proj", "y_proj", F.format_string("POINT(%f %f)", "x_proj", "y_proj").alias("geometry"))


def line_features(cells: DataFrame, by: list[str], order: str, kind: str, gt: tuple[float, ...]) -> DataFrame:
    """One LINESTRING for each group of ``by``, its points in ``order``."""
    p = cells.withColumn("at", F.format_string("%f %f", map_x(F.col("x"), gt[0], gt[1]), map_y(F.col("y"), gt[3], gt[5])))
    g = p.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col("at")))).alias("points"))
    return g.select(*by, F.lit(kind).alias("type"), F.concat(F.lit("LINESTRING("), F.array_join(F.transform("points", lambda s: s["at"]), ", "), F.lit(")")).alias("geometry"))


def section_features(sections: DataFrame, gt: tuple[float, ...]) -> DataFrame:
    """Two-point lines from the first to the last valid sample, numbered from one in reach and station order."""
    from pyspark.sql import Window

    v = sections.filter("valid")
    ends = v.groupBy("raster_id", "reach_id", "station").agg(F.min(F.struct("t", "y", "x")).alias("a"), F.max(F.struct("t", "y", "x")).alias("b"))
    two = ends.select("raster_id", "reach_id", "station", F.explode(F.array("a", "b")).alias("p")).select("raster_id", "reach_id", "station", "p.*")
    lines = line_features(two, ["raster_id", "reach_id", "station"], "t", "CrossSection", gt)
    return lines.withColumn("id", F.row_number().over(Window.partitionBy("raster_id").orderBy("reach_id", "station")))


def bank_features(banks: DataFrame, gt: tuple[float, ...]) -> DataFrame:
    return line_features(banks, ["raster_id", "reach_id", "side"], "station", "Bank", gt)


def outlet_rows(outlets: DataFrame) -> DataFrame:
    """BasinID, YIndex, XIndex."""
    return outlets.select("raster_id", F.col("basin").alias("BasinID"), F.col("y").alias("YIndex"), F.col("x").alias("XIndex"))


def stream_rows(reach_cells: DataFrame) -> DataFrame:
    """ID and the JSON list of [y, x] cells of each reach."""
    g = reach_cells.groupBy("raster_id", F.col("reach_id").alias("ID")).agg(F.array_sort(F.collect_list(F.struct("seq", "y", "x"))).alias("c"))
    return g.select("raster_id", "ID", F.to_json(F.transform("c", lambda s: F.array(s["y"], s["x"]))).alias("PathCellList"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def to_image(cells: DataFrame, c: str = "z", most: int = 512):
    """A raster thinned to at most ``most`` lines and columns, as an array for plotting. One raster."""
    step = cells.agg(F.greatest(F.max("ny"), F.max("nx"))).first()[0] // most + 1
    thin = cells.filter((F.col("y") % step == 0) & (F.col("x") % step == 0)).select((F.col("y") / step).cast("int").alias("y"), (F.col("x") / step).cast("int").alias("x"), c)
    return thin.toPandas().pivot(index="y", columns="x", values=c)
