"""From skeleton to channels: components, channel heads, geodesic distance, paths, reaches and cross-sections."""

from __future__ import annotations

import heapq
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extrema import local_extrema
from .graph import components, stored

#: The order in which neighbours are looked at (dy, dx): cardinal, then diagonal.
GATHER = ((1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (1, -1), (-1, 1))


def label_components(cells: DataFrame, c: str = "skel", connectivity: int = 8) -> DataFrame:
    """Add label: 1..n in row-major order of each component's first cell, 0 outside. Links go to neighbours by equi-join."""
    own = stored(cells.filter(F.col(c) == 1).select("raster_id", "y", "x", F.struct("raster_id", "y", "x").alias("node")), "skeleton")
    ahead = ((0, 1), (1, 0), (1, 1), (1, -1)) if connectivity == 8 else ((0, 1), (1, 0))
    moved = own.select("raster_id", F.col("node").alias("a"), "y", "x").withColumn("o", F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ahead])))
    moved = moved.select("raster_id", "a", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    edges = moved.join(own, ["raster_id", "y", "x"]).select("a", F.col("node").alias("b"))
    root = components(edges)
    named = own.join(root, "node", "left").select("raster_id", "y", "x", F.coalesce("root", "node").alias("root"))
    first = named.select("raster_id", "root").distinct()
    first = first.withColumn("label", F.row_number().over(Window.partitionBy("raster_id").orderBy("root.y", "root.x")))
    labelled = named.join(first, ["raster_id", "root"]).select("raster_id", "y", "x", "label")
    return cells.join(labelled, ["raster_id", "y", "x"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def component_sizes(cells: DataFrame) -> DataFrame:
    return cells.filter("label > 0").groupBy("raster_id", "label").agg(F.count(F.lit(1)).alias("n_cells"))


def size_threshold(sizes: DataFrame, edge: int = 2) -> DataFrame:
    """raster_id, n_labels, threshold: an edge of the histogram of all sizes but the largest, in floor(sqrt(n)) equal bins.

    With fewer bins than the edge's number the threshold is the least size.
    """
    w = Window.partitionBy("raster_id").orderBy(F.desc("n_cells"), F.desc("label"))
    x = sizes.withColumn("k", F.row_number().over(w))
    g = x.groupBy("raster_id").agg(F.count(F.lit(1)).alias("n_labels"), F.min("n_cells").alias("least"),
                                   F.min(F.when(F.col("k") > 1, F.col("n_cells"))).cast("double").alias("lo"), F.max(F.when(F.col("k") > 1, F.col("n_cells"))).cast("double").alias("hi"))
    bins = F.floor(F.sqrt("n_labels"))
    lo = F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo"))
    hi = F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))
    at = F.when(bins >= edge, lo + edge * ((hi - lo) / bins)).otherwise(F.col("least").cast("double"))
    return g.select("raster_id", F.col("n_labels").cast("long").alias("n_labels"), at.alias("threshold"))


def channel_heads(cells: DataFrame, box: int = 25, edge: int = 2, null_is_head: bool = False) -> DataFrame:
    """Skeleton cells of large components with no farther cell (geo) of their component in the box around them.

    The box reaches from box before to box - 1 after the cell and never into row or column 0. Cells meet by equi-join on
    blocks of the box's size, the searched side in its own and the neighbouring blocks.
    """
    sizes = component_sizes(cells)
    big = sizes.join(size_threshold(sizes, edge), "raster_id").filter("n_cells >= threshold").select("raster_id", "label")
    cand = cells.filter("label > 0").join(big, ["raster_id", "label"]).select("raster_id", "label", "y", "x", "geo")
    if not null_is_head:
        cand = cand.filter("geo is not null")
    a = cand.withColumn("by", F.floor(F.col("y") / box)).withColumn("bx", F.floor(F.col("x") / box))
    near = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    b = cells.filter("label > 0 and geo is not null and y > 0 and x > 0").select("raster_id", "label", F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("geo").alias("geo2"))
    b = b.withColumn("o", F.explode(near)).withColumn("by", F.floor(F.col("y2") / box) + F.col("o.dy")).withColumn("bx", F.floor(F.col("x2") / box) + F.col("o.dx")).drop("o")
    inside = (F.col("y2") >= F.col("y") - box) & (F.col("y2") < F.col("y") + box) & (F.col("x2") >= F.col("x") - box) & (F.col("x2") < F.col("x") + box)
    keys = ["raster_id", "label", "by", "bx"]
    on = [a[k] == b[k] for k in keys]
    return a.join(b, [*on, inside & (F.col("geo2") > F.col("geo"))], "left_anti").select("raster_id", "label", "y", "x", "geo")


def march(speed: np.ndarray, inside: np.ndarray, start: tuple[int, int]) -> np.ndarray:
    """Travel times by first-order fast marching: |grad T| speed = 1 from a zero level half a cell around the start."""
    ny, nx = speed.shape
    t = np.full((ny, nx), np.inf)
    known = np.zeros((ny, nx), bool)
    heap: list[tuple[float, int, int]] = []
    open_ = inside & (speed > 0)

    def slow(y: int, x: int) -> float:
        return 1.0 / speed[y, x]

    y0, x0 = start
    known[y0, x0] = True
    t[y0, x0] = 0.5 * slow(y0, x0) if open_[y0, x0] else 0.0

    def update(y: int, x: int) -> None:
        best = []
        for pair in (((-1, 0), (1, 0)), ((0, -1), (0, 1))):
            got = [t[y + dy, x + dx] if (y + dy, x + dx) != start else None for dy, dx in pair
                   if 0 <= y + dy < ny and 0 <= x + dx < nx and known[y + dy, x + dx]]
            if None in got:  # beside the start: the zero level lies half way
                return push(y, x, 0.5 * slow(y, x))
            if got:
                best.append(min(got))
        best.sort()
        f = slow(y, x)
        new = best[0] + f
        if len(best) == 2 and best[1] < new:
            new = (best[0] + best[1] + sqrt(max(0.0, 2 * f * f - (best[0] - best[1]) ** 2))) / 2
        push(y, x, new)

    def push(y: int, x: int, new: float) -> None:
        if new < t[y, x]:
            t[y, x] = new
            heapq.heappush(heap, (new, y, x))

    def spread(y: int, x: int) -> None:
        for dy, dx in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            v, w = y + dy, x + dx
            if 0 <= v < ny and 0 <= w < nx and open_[v, w] and not known[v, w]:
                update(v, w)

    spread(y0, x0)
    while heap:
        new, y, x = heapq.heappop(heap)
        if not known[y, x]:
            known[y, x] = True
            spread(y, x)
    return t


def geodesic(cells: DataFrame, starts: DataFrame) -> DataFrame:
    """Add geo: travel time from the basin's start point at the speed in ``cost``. Basins are independent tasks."""
    s = starts.select("raster_id", "basin", F.col("y").alias("sy"), F.col("x").alias("sx"))
    # Several start points of one basin: each is marched and the last by position stays, as they overwrite each other.
    s = s.withColumn("k", F.row_number().over(Window.partitionBy("raster_id", "basin").orderBy(F.desc("sy"), F.desc("sx")))).filter("k = 1").drop("k")
    own = cells.select("raster_id", "basin", "y", "x", "cost", "flow").join(s, ["raster_id", "basin"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(part["y"].min()), int(part["x"].min())
        shape = (int(part["y"].max()) - y0 + 1, int(part["x"].max()) - x0 + 1)
        speed, inside = np.zeros(shape), np.zeros(shape, bool)
        at = (part["y"].to_numpy() - y0, part["x"].to_numpy() - x0)
        speed[at] = np.nan_to_num(part["cost"].to_numpy(dtype=float, na_value=np.nan))
        inside[at] = part["flow"].to_numpy(dtype=float, na_value=np.nan) != 0
        t = march(speed, inside, (int(part["sy"].iloc[0]) - y0, int(part["sx"].iloc[0]) - x0))[at]
        return pd.DataFrame({"raster_id": part["raster_id"], "y": part["y"], "x": part["x"], "geo": np.where(np.isfinite(t), t, np.nan)})

    got = own.groupBy("raster_id", "basin").applyInPandas(run, "raster_id string, y int, x int, geo double")
    got = got.withColumn("geo", F.when(~F.isnan("geo"), F.col("geo")))
    return cells.join(got, ["raster_id", "y", "x"], "left")


def descend(geo: np.ndarray, start: tuple[int, int]) -> list[tuple[int, int]]:
    """Steepest descent: the neighbour with the greatest drop from the running level, which then is the least neighbour.

    Cells beyond the array, and those with +inf, are no way; a NaN neighbour, a level that would rise, or a cell met before ends it.
    """
    ny, nx = geo.shape
    y, x = start
    level, path, met = geo[y, x], [start], {start}
    while True:
        near = np.array([geo[y + dy, x + dx] if 0 <= y + dy < ny and 0 <= x + dx < nx else np.inf for dy, dx in GATHER])
        if np.isnan(near).any() or np.isnan(level) or near.min() > level:
            return path
        drop = (level - near) / np.array([1, 1, 1, 1, sqrt(2), sqrt(2), sqrt(2), sqrt(2)])
        dy, dx = GATHER[int(np.argmax(drop))]
        level, y, x = near.min(), y + dy, x + dx
        if (y, x) in met:
            return path
        path.append((y, x))
        met.add((y, x))


def paths(cells: DataFrame, heads: DataFrame) -> DataFrame:
    """raster_id, path_id, seq, y, x: from each head down the geodesic distance of its basin."""
    h = heads.select("raster_id", "y", "x")
    h = h.withColumn("path_id", F.row_number().over(Window.partitionBy("raster_id").orderBy("y", "x")))
    marked = cells.select("raster_id", "basin", "y", "x", "geo").join(h, ["raster_id", "y", "x"], "left")
    wanted = marked.filter("path_id is not null").select("raster_id", "basin").distinct()
    marked = marked.join(wanted, ["raster_id", "basin"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        y0, x0 = int(part["y"].min()), int(part["x"].min())
        geo = np.full((int(part["y"].max()) - y0 + 1, int(part["x"].max()) - x0 + 1), np.inf)
        value = part["geo"].to_numpy(dtype=float, na_value=np.nan)
        geo[part["y"] - y0, part["x"] - x0] = np.where(value == 0, np.inf, value)
        rows = []
        for p in part[part["path_id"].notna()].itertuples():
            rows += [(p.raster_id, int(p.path_id), k, y + y0, x + x0) for k, (y, x) in enumerate(descend(geo, (p.y - y0, p.x - x0)))]
        return pd.DataFrame(rows, columns=["raster_id", "path_id", "seq", "y", "x"])

    return marked.groupBy("raster_id", "basin").applyInPandas(run, "raster_id string, path_id int, seq int, y int, x int")


def visit_counts(path_cells: DataFrame) -> DataFrame:
    return path_cells.groupBy("raster_id", "y", "x").agg(F.count(F.lit(1)).alias("n_paths"))


def split_reaches(rows: list[tuple[int, int, int, int]]) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """Reaches (reach_id, seq, y, x) and junctions (y, x) of ordered (path_id, y, x, visits) rows."""
    reaches: list[list[tuple[int, int]]] = []
    starts: set[tuple[int, int]] = set()
    junctions: list[tuple[int, int]] = []
    path = last = None
    skip = False
    for p, y, x, n in rows:
        if p != path:
            path, skip = p, False
            reaches.append([(y, x)])
            starts.add((y, x))
        elif skip:
            continue
        elif n == last:
            reaches[-1].append((y, x))
        else:
            reaches[-1].append((y, x))
            if (y, x) in starts:
                skip = True
            else:
                junctions.append((y, x))
                starts.add((y, x))
                reaches.append([(y, x)])
        last = n
    return [(i + 1, k, y, x) for i, r in enumerate(reaches) for k, (y, x) in enumerate(r)], junctions


def reaches(path_cells: DataFrame) -> DataFrame:
    """raster_id, kind (reach or junction), reach_id, seq, y, x. Paths are few against cells; the fold is in their order."""
    counted = path_cells.join(visit_counts(path_cells), ["raster_id", "y", "x"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["path_id", "seq"])
        got, junctions = split_reaches(list(zip(part["path_id"], part["y"], part["x"], part["n_paths"])))
        rid = part["raster_id"].iloc[0]
        rows = [(rid, "reach", *r) for r in got] + [(rid, "junction", 0, k, y, x) for k, (y, x) in enumerate(junctions)]
        return pd.DataFrame(rows, columns=["raster_id", "kind", "reach_id", "seq", "y", "x"])

    return counted.groupBy("raster_id").applyInPandas(run, "raster_id string, kind string, reach_id int, seq int, y int, x int")


SKIP, GAP, AHEAD, HALF = 5, 5, 3, 20


def section_samples(reach_cells: DataFrame, skip: int = SKIP, gap: int = GAP, ahead: int = AHEAD, half: int = HALF) -> DataFrame:
    """raster_id, reach_id, station, t, y, x: positions across the channel, t from -half; index 0 is the left bank's side."""
    w = Window.partitionBy("raster_id", "reach_id")
    r = reach_cells.select("raster_id", "reach_id", "seq", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    order = w.orderBy("seq")
    for k, n in (("l", ahead), ("r", -ahead)):
        for c in "yx":
            r = r.withColumn(f"{k}{c}", F.lead(c, n).over(order) if n > 0 else F.lag(c, -n).over(order))
    r = r.withColumn("n", F.count(F.lit(1)).over(w))
    r = r.filter((F.floor((F.col("n") - 2 * skip) / gap) > 0) & (F.col("seq") >= skip) & (F.col("seq") < F.col("n") - skip) & ((F.col("seq") - skip) % gap == 0))
    dx, dy = F.col("lx") - F.col("rx"), F.col("ly") - F.col("ry")
    m = F.sqrt(dx * dx + dy * dy)
    r = r.withColumn("m", m).filter("m > 0")
    sin = F.when((dx > 0) & (dy < 0), -dy).when((dx < 0) & (dy > 0), dy).otherwise(F.abs(dy)) / F.col("m")
    cos = F.when((dx > 0) & (dy < 0), -dx).when((dx < 0) & (dy > 0), dx).otherwise(F.abs(dx)) / F.col("m")
    r = r.withColumn("sin", sin).withColumn("cos", cos)
    x_of = lambda t: F.when(F.col("sin") < 0, F.col("x") + t * F.col("sin")).otherwise(F.col("x") - t * F.col("sin"))
    y_of = lambda t: F.col("y") + t * F.col("cos")
    turned = (x_of(F.lit(-float(half))) - F.col("lx")) * dy - (y_of(F.lit(-float(half))) - F.col("ly")) * dx > 0
    r = r.withColumn("turned", turned).withColumn("t", F.explode(F.sequence(F.lit(-half), F.lit(half))))
    t = F.when(F.col("turned"), -F.col("t")).otherwise(F.col("t")).cast("double")
    return r.select("raster_id", "reach_id", F.col("seq").alias("station"), "t", F.round(y_of(t)).cast("int").alias("y"), F.round(x_of(t)).cast("int").alias("x"))


def cross_sections(cells: DataFrame, reach_cells: DataFrame, c: str = "z") -> DataFrame:
    """Samples with their elevation, slope and validity; invalid samples have 0 for both."""
    s = section_samples(reach_cells)
    known = cells.filter(F.col(c).isNotNull()).select("raster_id", "y", "x", F.col(c).cast("double").alias("elevation"), F.col("slope"), F.lit(True).alias("valid"))
    x = s.join(known, ["raster_id", "y", "x"], "left")
    return x.select("raster_id", "reach_id", "station", "t", "y", "x", F.coalesce("valid", F.lit(False)).alias("valid"),
                    F.coalesce("elevation", F.lit(0.0)).alias("elevation"), F.coalesce("slope", F.lit(0.0)).alias("slope"))


def bank_points(sections: DataFrame, right_offset: int = 22) -> DataFrame:
    """raster_id, reach_id, station, side, t, y, x, elevation, water_level of each section with a valid sample.

    A bank is the greatest local maximum of slope on its side of the centre.
    """
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("t").reset_index(drop=True)
        if not part["valid"].any():
            return pd.DataFrame(columns=list("abcdefghi")).set_axis(["raster_id", "reach_id", "station", "side", "t", "y", "x", "elevation", "water_level"], axis=1)
        slope = part["slope"].to_numpy()
        half = len(slope) // 2
        left = local_extrema(slope[:half])[1][0]
        right = min(local_extrema(slope[half + 2:])[1][0] + right_offset, len(slope) - 1)
        level = float(min(part["elevation"][left], part["elevation"][right]))
        return pd.DataFrame([(part["raster_id"][0], int(part["reach_id"][0]), int(part["station"][0]), side, int(part["t"][k]), int(part["y"][k]), int(part["x"][k]), float(part["elevation"][k]), level)
                             for side, k in (("left", left), ("right", right))], columns=["raster_id", "reach_id", "station", "side", "t", "y", "x", "elevation", "water_level"])

    return sections.groupBy("raster_id", "reach_id", "station").applyInPandas(
        run, "raster_id string, reach_id int, station int, side string, t int, y int, x int, elevation double, water_level double")


def section_map(cells: DataFrame, reach_cells: DataFrame, sections: DataFrame, banks: DataFrame, c: str = "z") -> DataFrame:
    """raster_id, y, x, code: 0 nodata, 999 ground, 1 centre line, 2 section, 3 bank; the higher step wins."""
    def mark(d: DataFrame, code: int) -> DataFrame:
        return d.select("raster_id", "y", "x", F.lit(code).alias("m"))

    marks = mark(reach_cells, 1).unionByName(mark(sections.filter("valid"), 2)).unionByName(mark(banks, 3))
    top = marks.groupBy("raster_id", "y", "x").agg(F.max("m").alias("m"))
    x = cells.select("raster_id", "y", "x", F.col(c).alias("z")).join(top, ["raster_id", "y", "x"], "left")
    code: Column = F.coalesce("m", F.when(F.col("z").isNull(), 0).otherwise(999))
    return x.select("raster_id", "y", "x", code.cast("int").alias("code"))
