"""Projections and predicates on the wide cell table (raster_id, y, x, z, ny, nx, layers...). Nodata is NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OFFSETS = {1: (-1, 1), 2: (-1, 0), 3: (-1, -1), 4: (0, -1), 5: (1, -1), 6: (1, 0), 7: (1, 1), 8: (0, 1)}
"""(dy, dx) of the eight direction codes, counter-clockwise from north-east."""


def mask_nodata(c: str | Column = "z", nodata: float = -9999.0, inclusive: bool = False) -> Column:
    """Values below nodata (at it too, if inclusive) and NaN become NULL."""
    c = F.col(c) if isinstance(c, str) else c
    keep = c > nodata if inclusive else c >= nodata
    return F.when(keep & ~F.isnan(c), c)


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < F.lit(float("inf")))


def mask_by(c: str, other: str, fill: float | None = None) -> Column:
    """A layer where another has data; elsewhere ``fill``."""
    return F.when(F.col(other).isNotNull(), F.col(c)).otherwise(F.lit(fill))


def single_threshold(c: str, t: Column | float) -> Column:
    return F.coalesce((F.col(c) > t).cast("int"), F.lit(0))


def dual_threshold(a: str, b: str, ta: Column | float, tb: Column | float) -> Column:
    return F.coalesce(((F.col(a) > ta) & (F.col(b) > tb)).cast("int"), F.lit(0))


def with_stats(cells: DataFrame, c: str, **named: Column) -> DataFrame:
    """Scalar statistics of a layer joined to its raster: one aggregate row a raster, an equi-join."""
    return cells.join(cells.groupBy("raster_id").agg(*[v.alias(k) for k, v in named.items()]), "raster_id")


def normalized(cells: DataFrame, c: str, to: str | None = None) -> DataFrame:
    """(c - min) / (max - min) over each raster; NULL where the raster is constant."""
    x = with_stats(cells, c, __lo=F.min(c), __hi=F.max(c))
    return x.withColumn(to or c, F.try_divide(F.col(c) - F.col("__lo"), F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")


def prepare_curvature(cells: DataFrame, normalize: bool = True) -> DataFrame:
    x = normalized(cells, "curv") if normalize else cells
    return x.withColumn("curv", F.coalesce("curv", F.lit(0.0)))


def local_cost(cells: DataFrame, expression: str, floor: float | None = None) -> DataFrame:
    """Reciprocal cost from a SQL expression over flow, flow_mean, skel, curv and slope; below ``floor`` it is 1."""
    x = with_stats(cells, "flow", flow_mean=F.avg("flow")) if "flow_mean" in expression else cells
    cost = F.expr(expression)
    return x.withColumn("cost", cost if floor is None else F.when(cost < floor, 1.0).otherwise(cost)).drop("flow_mean")


def map_x(x: Column, gt0: float, gt1: float, centre: bool = False) -> Column:
    return F.lit(gt0) + F.lit(gt1) * (x + F.lit(0.5 if centre else 0.0))


map_y = map_x


def to_points(cells: DataFrame, where: Column | str, kind: str) -> DataFrame:
    """Row-major point list: raster_id, kind, cat (from 1), y, x."""
    order = Window.partitionBy("raster_id").orderBy("y", "x")
    return cells.filter(where).select("raster_id", F.lit(kind).alias("kind"), "y", "x").withColumn("cat", F.row_number().over(order))
