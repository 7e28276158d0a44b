"""Flow routing: D8 directions, accumulation and basins, priority flood, multiple flow directions.

D8 is a stencil, accumulation and basins are pointer doubling over the cell forest: no task ever holds
a raster. Priority flood, which lets water leave pits, orders a whole raster by level and so is a kernel per raster.
"""

from __future__ import annotations

import heapq
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.algebra import OFFSETS
from .graph import accumulate
from .stencil import neighbours

ROOT2 = sqrt(2.0)


def d8_direction(cells: DataFrame, c: str = "z") -> DataFrame:
    """Add fdr: the code of the steepest descent (the lowest code on ties), 0 in a pit, negative where water leaves the grid."""
    x = neighbours(cells, c)
    drops = [((F.col(c) - F.col(f"n{k}")) / (ROOT2 if k % 2 else 1.0)) for k in range(1, 9)]
    best = F.greatest(*[F.coalesce(d, F.lit(float("-inf"))) for d in drops])
    code = F.lit(None).cast("int")
    for k in range(8, 0, -1):
        code = F.when(drops[k - 1] == best, F.lit(k)).otherwise(code)
    leaves = F.when(F.col("y") == 0, -2).when(F.col("y") == F.col("ny") - 1, -6).when(F.col("x") == 0, -4).when(F.col("x") == F.col("nx") - 1, -8)
    fdr = F.when(F.col(c).isNull(), None).when(best > 0, code).otherwise(F.coalesce(leaves, F.lit(0)))
    return x.withColumn("fdr", fdr.cast("int")).drop(*[f"n{k}" for k in range(1, 9)])


def _step(code: Column, which: int) -> Column:
    c = F.lit(None).cast("int")
    for k, o in OFFSETS.items():
        c = F.when(code == k, F.lit(o[which])).otherwise(c)
    return c


def pointers(cells: DataFrame) -> DataFrame:
    """raster_id, id, ptr of each cell with a direction; id = y * nx + x."""
    at = F.col("y").cast("long") * F.col("nx") + F.col("x")
    to = (F.col("y") + _step(F.col("fdr"), 0)).cast("long") * F.col("nx") + F.col("x") + _step(F.col("fdr"), 1)
    return cells.filter("fdr is not null").select("raster_id", at.alias("id"), F.when(F.col("fdr") > 0, to).alias("ptr"))


def outlets(cells: DataFrame) -> DataFrame:
    """Cells where water leaves the grid."""
    return cells.filter("fdr < 0")


def accumulation(cells: DataFrame) -> DataFrame:
    """Add fac (cells upstream, itself included) and basin (1 + the rank-free id of the cell it drains to; 0 for none)."""
    got = accumulate(pointers(cells)).select("raster_id", "id", F.col("acc").alias("fac"), (F.col("root") + 1).alias("basin"))
    x = cells.withColumn("id", F.col("y").cast("long") * F.col("nx") + F.col("x"))
    return x.join(got, ["raster_id", "id"], "left").drop("id").withColumn("basin", F.coalesce("basin", F.lit(0).cast("long")))


def basin_area(cells: DataFrame) -> DataFrame:
    """raster_id, basin, n_cells, percent of the whole grid."""
    n = cells.filter("basin > 0").groupBy("raster_id", "basin", "ny", "nx").agg(F.count(F.lit(1)).alias("n_cells"))
    return n.select("raster_id", "basin", "n_cells", (F.lit(100.0) * F.col("n_cells") / (F.col("ny") * F.col("nx"))).alias("percent"))


def start_points(cells: DataFrame, min_percent: float = 0.5, min_cells: int = 6) -> DataFrame:
    """Outlets of basins above both limits: raster_id, y, x, basin, n_cells."""
    big = basin_area(cells).filter((F.col("percent") > min_percent) & (F.col("n_cells") > min_cells))
    return outlets(cells).select("raster_id", "y", "x", "basin").join(big.select("raster_id", "basin", "n_cells"), ["raster_id", "basin"])


def flood(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Priority flood of an array with NaN as nodata: directions, order of flooding (outlets first), filled levels."""
    ny, nx = z.shape
    code, order, level = np.zeros((ny, nx), np.int32), np.full((ny, nx), -1, np.int64), z.copy()
    valid = ~np.isnan(z)
    heap: list[tuple[float, int, int, int]] = []
    seen = ~valid
    k = 0
    rim = np.zeros_like(valid)
    rim[0], rim[-1], rim[:, 0], rim[:, -1] = True, True, True, True
    for y, x in zip(*np.nonzero(valid & rim)):
        heapq.heappush(heap, (z[y, x], k, int(y), int(x)))
        k += 1
        seen[y, x] = True
        code[y, x] = -2 if y == 0 else -6 if y == ny - 1 else -4 if x == 0 else -8
    done = 0
    while True:
        if not heap:  # an island within nodata drains at its lowest cell
            rest = np.where(seen, np.inf, z)
            if not np.isfinite(rest).any():
                break
            y, x = divmod(int(rest.argmin()), nx)
            heapq.heappush(heap, (z[y, x], k, y, x))
            k, seen[y, x], code[y, x] = k + 1, True, -2
        h, _, y, x = heapq.heappop(heap)
        order[y, x] = done
        done += 1
        for c, (dy, dx) in OFFSETS.items():
            v, w = y + dy, x + dx
            if 0 <= v < ny and 0 <= w < nx and not seen[v, w]:
                seen[v, w] = True
                level[v, w] = max(z[v, w], h)
                code[v, w] = (c + 3) % 8 + 1  # back to where the water goes
                heapq.heappush(heap, (level[v, w], k, v, w))
                k += 1
    # A rim cell with a lower neighbour that is filled no higher drains there, not off the grid.
    for y, x in zip(*np.nonzero(valid & rim)):
        best = max(((level[y, x] - level[y + dy, x + dx]) / (ROOT2 if c % 2 else 1.0), -c) for c, (dy, dx) in OFFSETS.items()
                   if 0 <= y + dy < ny and 0 <= x + dx < nx and valid[y + dy, x + dx]) if valid.sum() > 1 and any(
                       0 <= y + dy < ny and 0 <= x + dx < nx and valid[y + dy, x + dx] for dy, dx in OFFSETS.values()) else (0, 0)
        if best[0] > 0:
            code[y, x] = -best[1]
    return np.where(valid, code, 0), order, level


def multiple_flow(z: np.ndarray, level: np.ndarray, code: np.ndarray, order: np.ndarray, power: float = 1.1) -> np.ndarray:
    """Accumulation when each cell's water divides over all lower neighbours by slope; on filled flats it follows ``code``."""
    ny, nx = z.shape
    acc = np.where(np.isnan(z), np.nan, 1.0)
    cells = np.argwhere(order >= 0)
    rank = np.lexsort((-order[tuple(cells.T)], -level[tuple(cells.T)]))
    for y, x in cells[rank]:
        share = {}
        for c, (dy, dx) in OFFSETS.items():
            v, w = y + dy, x + dx
            if 0 <= v < ny and 0 <= w < nx and order[v, w] >= 0 and level[v, w] < level[y, x]:
                share[v, w] = ((level[y, x] - level[v, w]) / (ROOT2 if c % 2 else 1.0)) ** power
        if not share and code[y, x] > 0:
            dy, dx = OFFSETS[int(code[y, x])]
            share = {(y + dy, x + dx): 1.0}
        total = sum(share.values())
        for to, s in share.items():
            acc[to] += acc[y, x] * s / total
    return acc


def priority_flood(cells: DataFrame, c: str = "z", accumulate_mfd: bool = False) -> DataFrame:
    """Add fdr by priority flood and the filled level (and mfd with accumulate_mfd); one task a raster."""
    def run(part: pd.DataFrame) -> pd.DataFrame:
        ny, nx = int(part["ny"].iloc[0]), int(part["nx"].iloc[0])
        z = np.full((ny, nx), np.nan)
        z[part["y"], part["x"]] = part[c].to_numpy(dtype=float, na_value=np.nan)
        code, order, level = flood(z)
        at = (part["y"].to_numpy(), part["x"].to_numpy())
        known = order[at] >= 0
        out = pd.DataFrame({"raster_id": part["raster_id"], "y": part["y"], "x": part["x"], "fdr": pd.array(np.where(known, code[at], 0), "Int32"), "level": level[at], "mfd": np.nan})
        out.loc[~known, "fdr"] = pd.NA
        if accumulate_mfd:
            out["mfd"] = multiple_flow(z, level, code, order)[at]
        return out

    got = cells.select("raster_id", "y", "x", c, "ny", "nx").groupBy("raster_id").applyInPandas(run, "raster_id string, y int, x int, fdr int, level double, mfd double")
    got = got.withColumn("level", F.when(~F.isnan("level"), F.col("level"))).withColumn("mfd", F.when(~F.isnan("mfd"), F.col("mfd")))
    return cells.join(got if accumulate_mfd else got.drop("mfd"), ["raster_id", "y", "x"])
