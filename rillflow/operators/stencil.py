"""Neighbourhood operators: gradients, slope, curvature, diffusion and smoothing.

Cells are dense: each raster has every (y, x) of its ny x nx grid, with NULL as nodata (``densify``). Short stencils are
windows along columns and rows. Iterated stencils cut the raster into strips of rows that overlap by their
reach and run one NumPy kernel on each: one shuffle, whatever the number of iterations, and memory bounded by a strip.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def down() -> WindowSpec:
    return Window.partitionBy("raster_id", "x").orderBy("y")


def along() -> WindowSpec:
    return Window.partitionBy("raster_id", "y").orderBy("x")


def with_shape(cells: DataFrame) -> DataFrame:
    """Add ny and nx, the extent of each raster."""
    shape = cells.groupBy("raster_id").agg((F.max("y") + 1).cast("int").alias("ny"), (F.max("x") + 1).cast("int").alias("nx"))
    return cells.join(shape, "raster_id")


def densify(cells: DataFrame, c: str = "z") -> DataFrame:
    """All cells of each grid, absent ones as nodata; adds ny and nx."""
    shape = cells.groupBy("raster_id").agg((F.max("y") + 1).cast("int").alias("ny"), (F.max("x") + 1).cast("int").alias("nx"))
    grid = shape.withColumn("y", F.explode(F.expr("sequence(0, ny - 1)"))).withColumn("x", F.explode(F.expr("sequence(0, nx - 1)")))
    return grid.join(cells.select("raster_id", "y", "x", c), ["raster_id", "y", "x"], "left").select("raster_id", "y", "x", c, "ny", "nx")


def _derivative(c: str, axis: str, h: float) -> Column:
    w, n = (down(), "ny") if axis == "y" else (along(), "nx")
    before, after, here, at = F.lag(c).over(w), F.lead(c).over(w), F.col(c), F.col(axis)
    # Edges go by position, not by missing values: a nodata neighbour is no edge.
    return (F.when(F.col(n) < 2, F.lit(None).cast("double")).when(at == 0, (after - here) / h)
            .when(at == F.col(n) - 1, (here - before) / h).otherwise((after - before) / (2 * h)))


def gradient(cells: DataFrame, c: str = "z", h: float = 1.0, to: tuple[str, str] = ("gy", "gx")) -> DataFrame:
    """Central differences, one-sided at the edges; the row direction first."""
    return cells.withColumn(to[0], _derivative(c, "y", h)).withColumn(to[1], _derivative(c, "x", h))


def slope(cells: DataFrame, c: str = "z", h: float = 1.0) -> DataFrame:
    return gradient(cells, c, h).withColumn("slope", F.sqrt(F.col("gy") * F.col("gy") + F.col("gx") * F.col("gx")))


def curvature(cells: DataFrame, c: str = "z", h: float = 1.0, method: str = "geometric", zero_fill: bool = True) -> DataFrame:
    """Divergence of the (unit) gradient; cells where it is undefined are 0, or NULL without zero_fill."""
    x = gradient(cells, c, h, ("__gy", "__gx"))
    if method == "geometric":
        norm = F.sqrt(F.col("__gy") * F.col("__gy") + F.col("__gx") * F.col("__gx"))
        x = x.withColumn("__n", norm).withColumn("__gy", F.try_divide("__gy", "__n")).withColumn("__gx", F.try_divide("__gx", "__n")).drop("__n")
    elif method != "laplacian":
        raise ValueError(method)
    x = x.withColumn("__cy", _derivative("__gy", "y", h)).withColumn("__cx", _derivative("__gx", "x", h))
    curv = F.col("__cy") + F.col("__cx")
    return x.withColumn("curv", F.coalesce(curv, F.lit(0.0)) if zero_fill else curv).drop("__gy", "__gx", "__cy", "__cx")


def diffuse_sql(cells: DataFrame, c: str = "z", steps: int = 1, kappa: float = 1.0, gamma: float = 0.1, h: float = 1.0, option: int = 2) -> DataFrame:
    """Perona-Malik diffusion as windows, for few steps: every step shuffles for columns and rows."""
    def flow(d: Column) -> Column:
        r = d / kappa
        return (F.exp(-(r * r)) if option == 1 else 1 / (1 + r * r)) / h * d

    for _ in range(steps):
        south = F.when(F.col("y") == F.col("ny") - 1, 0.0).otherwise(F.lead(c).over(down()) - F.col(c))
        east = F.when(F.col("x") == F.col("nx") - 1, 0.0).otherwise(F.lead(c).over(along()) - F.col(c))
        x = cells.withColumn("__s", flow(south)).withColumn("__ns", F.when(F.col("y") == 0, F.col("__s")).otherwise(F.col("__s") - F.lag("__s").over(down())))
        x = x.withColumn("__e", flow(east)).withColumn("__ew", F.when(F.col("x") == 0, F.col("__e")).otherwise(F.col("__e") - F.lag("__e").over(along())))
        both = F.when(F.col("__ns").isNotNull() | F.col("__ew").isNotNull(), F.coalesce("__ns", F.lit(0.0)) + F.coalesce("__ew", F.lit(0.0)))
        cells = x.withColumn(c, F.col(c) + gamma * both).drop("__s", "__e", "__ns", "__ew")
    return cells


def diffusion_kernel(steps: int, kappa: float, gamma: float, h: float, option: int, precision: str = "double", drop_missing: bool = True) -> Callable:
    """The same on an array with NaN as nodata. drop_missing: a missing direction counts as no flow if the other is known."""
    def kernel(z: np.ndarray) -> np.ndarray:
        z = z.astype(np.float32 if precision == "float32" else np.float64)
        for _ in range(steps):
            s, e = np.zeros_like(z), np.zeros_like(z)
            s[:-1], e[:, :-1] = z[1:] - z[:-1], z[:, 1:] - z[:, :-1]
            s, e = ((np.exp(-(d / kappa) ** 2) if option == 1 else 1 / (1 + (d / kappa) ** 2)) / h * d for d in (s, e))
            ns, ew = s.copy(), e.copy()
            ns[1:] -= s[:-1]
            ew[:, 1:] -= e[:, :-1]
            if drop_missing:
                lost = np.isnan(ns) & np.isnan(ew)
                change = np.where(lost, np.nan, np.nan_to_num(ns) + np.nan_to_num(ew))
            else:
                change = ns + ew
            z = (z + gamma * change).astype(z.dtype)
        return z
    return kernel


def catte_kernel(steps: int, kappa: float, dt: float, variance: float, method: str) -> Callable:
    """Diffusion whose edge stopping looks at a Gaussian-smoothed image; methods linear, perona_malik_1, perona_malik_2."""
    def conduct(d: np.ndarray) -> np.ndarray:
        if method == "linear":
            return np.ones_like(d)
        return np.exp(-(d / kappa) ** 2) if method == "perona_malik_1" else 1 / (1 + (d / kappa) ** 2)

    def kernel(z: np.ndarray) -> np.ndarray:
        for _ in range(steps):
            g = smoothing_kernel(variance)(z) if variance > 0 else z
            p, q = np.pad(z, 1, mode="edge"), np.pad(g, 1, mode="edge")
            c = (slice(1, -1), slice(1, -1))
            near = ((slice(0, -2), c[1]), (slice(2, None), c[1]), (c[0], slice(0, -2)), (c[0], slice(2, None)))
            z = z + dt * sum(conduct(q[n] - q[c]) * (p[n] - p[c]) for n in near)
        return z
    return kernel


def gaussian_weights(variance: float, size: int = 5) -> np.ndarray:
    at = np.arange(size) - size // 2
    g = np.exp(-(at[:, None] ** 2 + at[None, :] ** 2) / (2 * variance))
    return g / g.sum()


def smoothing_kernel(variance: float, size: int = 5) -> Callable:
    """Gaussian smoothing; two lines beyond each edge are the mean of what is known of the two lines at that edge."""
    weights = gaussian_weights(variance, size)
    pad = size // 2

    def mean(z: np.ndarray, axis: int) -> np.ndarray:
        known = ~np.isnan(z)
        n = known.sum(axis=axis, keepdims=True)
        return np.where(n, np.where(known, z, 0).sum(axis=axis, keepdims=True) / np.maximum(n, 1), np.nan)

    def kernel(z: np.ndarray) -> np.ndarray:
        left, right = mean(z[:, :2], 1), mean(z[:, -2:], 1)
        wide = np.hstack([left] * pad + [z] + [right] * pad)
        top, bottom = mean(wide[:2], 0), mean(wide[-2:], 0)
        wide = np.vstack([top] * pad + [wide] + [bottom] * pad)
        ny, nx = z.shape
        return sum(weights[i, j] * wide[i:i + ny, j:j + nx] for i in range(size) for j in range(size))
    return kernel


def stencil_apply(cells: DataFrame, kernel: Callable, reach: int, c: str = "z", to: str | None = None, rows: int = 256) -> DataFrame:
    """Run an array kernel over strips of ``rows`` rows with ``reach`` rows of overlap on either side.

    Exact for kernels whose cells depend on rows at most ``reach`` away. At the raster's own edges strips end where it ends.
    """
    to = to or c
    rows = max(rows, 2 * reach)
    last = F.floor((F.col("ny") - 1) / rows)
    first_strip = F.greatest(F.lit(0), F.floor((F.col("y") - reach) / rows))
    last_strip = F.least(last, F.floor((F.col("y") + reach) / rows))
    spread = cells.select("raster_id", "y", "x", c, "ny", "nx", F.explode(F.sequence(first_strip.cast("int"), last_strip.cast("int"))).alias("strip"))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        y0, nx = int(part["y"].min()), int(part["nx"].iloc[0])
        a = np.full((int(part["y"].max()) - y0 + 1, nx), np.nan)
        a[part["y"] - y0, part["x"]] = part[c].to_numpy(dtype=float, na_value=np.nan)
        with np.errstate(invalid="ignore", over="ignore"):
            b = np.asarray(kernel(a), float)
        s = int(part["strip"].iloc[0])
        part = part[(part["y"] >= s * rows) & (part["y"] < (s + 1) * rows)]
        v = b[part["y"] - y0, part["x"]]
        return pd.DataFrame({"raster_id": part["raster_id"], "y": part["y"], "x": part["x"], "__v": v})

    got = spread.groupBy("raster_id", "strip").applyInPandas(run, "raster_id string, y int, x int, __v double")
    got = got.withColumn("__v", F.when(~F.isnan("__v"), F.col("__v")))
    keep = [k for k in cells.columns if k != to]
    if set(keep) <= {"raster_id", "y", "x", "ny", "nx"} and to == c:
        shape = cells.groupBy("raster_id").agg(F.first("ny").alias("ny"), F.first("nx").alias("nx"))
        return got.withColumnRenamed("__v", to).join(shape, "raster_id").select(*cells.columns)
    return cells.select(*keep).join(got, ["raster_id", "y", "x"]).withColumnRenamed("__v", to)


def diffuse(cells: DataFrame, steps: int, kappa: float, gamma: float = 0.1, h: float = 1.0, option: int = 2, precision: str = "double", c: str = "z", rows: int = 256) -> DataFrame:
    return stencil_apply(cells, diffusion_kernel(steps, kappa, gamma, h, option, precision), steps, c, rows=rows)


def smooth(cells: DataFrame, variance: float = 0.05, c: str = "z", rows: int = 256) -> DataFrame:
    return stencil_apply(cells, smoothing_kernel(variance), 4, c, rows=rows)


def neighbours(cells: DataFrame, c: str = "z") -> DataFrame:
    """Eight columns n1..n8 with the values at the direction codes; NULL beyond the grid and at nodata."""
    x = cells.withColumn("__up", F.lag(c).over(down())).withColumn("__down", F.lead(c).over(down()))
    at = {1: ("__up", 1), 2: ("__up", 0), 3: ("__up", -1), 4: (c, -1), 5: ("__down", -1), 6: ("__down", 0), 7: ("__down", 1), 8: (c, 1)}
    for code, (of, dx) in at.items():
        x = x.withColumn(f"n{code}", F.col(of) if dx == 0 else F.lead(of).over(along()) if dx == 1 else F.lag(of).over(along()))
    return x.drop("__up", "__down")
