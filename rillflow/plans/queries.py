"""The registered queries of the terrain operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TerrainConfig
from ..functions import algebra, stats
from ..functions.extrema import local_extrema
from ..operators import flow, network, stencil
from ..operators.graph import shared_dir, stored
from ..sources import geotiff, tables
from . import pipeline, rasters
from .rasters import FORMS, GT, NX, NY

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f
    return put


def _r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def _out(df: DataFrame, *exact: str, **rounded) -> DataFrame:
    return df.select(*exact, *[_r(c).alias(k) for k, c in rounded.items()])


# SQL pieces -----------------------------------------------------------------------------------------------------------

EMB = "SELECT 'emb' AS raster_id, CAST(vec_id AS INT) AS y, CAST(i - 1 AS INT) AS x, CAST(embedding[i] AS DOUBLE) AS z, (SELECT CAST(max(vec_id) + 1 AS INT) FROM embeddings) AS ny, 64 AS nx FROM embeddings, range(1, 65) t(i)"
_LI = "SELECT CAST(l_orderkey % 64 AS INT) AS y, CAST(l_partkey % 64 AS INT) AS x, CAST(max(l_quantity) AS DOUBLE) AS z FROM lineitem GROUP BY 1, 2"
LI = f"SELECT 'li' AS raster_id, g.y, g.x, s.z, g.ny, g.nx FROM (SELECT CAST(a.i AS INT) AS y, CAST(b.i AS INT) AS x, n.ny, n.nx FROM (SELECT max(y) + 1 AS ny, max(x) + 1 AS nx FROM ({_LI})) n, range(0, 64) a(i), range(0, 64) b(i) WHERE a.i < n.ny AND b.i < n.nx) g LEFT JOIN ({_LI}) s USING (y, x)"


def _form(name: str) -> str:
    return f"SELECT '{name}' AS raster_id, y, x, {FORMS[name]} AS z, {NY} AS ny, {NX} AS nx FROM (SELECT CAST(a.i AS INT) AS y, CAST(b.i AS INT) AS x FROM range(0, {NY}) a(i), range(0, {NX}) b(i))"


def _w(axis: str) -> str:
    return "(PARTITION BY raster_id, x ORDER BY y)" if axis == "y" else "(PARTITION BY raster_id, y ORDER BY x)"


def _d(c: str, axis: str) -> str:
    n, w = f"n{axis}", _w(axis)
    return f"CASE WHEN {axis} = 0 THEN lead({c}) OVER {w} - {c} WHEN {axis} = {n} - 1 THEN {c} - lag({c}) OVER {w} ELSE (lead({c}) OVER {w} - lag({c}) OVER {w}) / 2 END"


def _grad(src: str) -> str:
    return f"SELECT *, {_d('z', 'y')} AS gy, {_d('z', 'x')} AS gx FROM ({src})"


def _slope(src: str) -> str:
    return f"SELECT *, sqrt(gy * gy + gx * gx) AS slope FROM ({_grad(src)})"


def _curv(src: str, geometric: bool = True) -> str:
    unit = f"SELECT * REPLACE (gy / nullif(slope, 0) AS gy, gx / nullif(slope, 0) AS gx) FROM ({_slope(src)})" if geometric else _grad(src)
    return f"SELECT *, coalesce({_d('gy', 'y')} + {_d('gx', 'x')}, 0) AS curv FROM ({unit})"


def _diffused(src: str, kappa: str, option: int, steps: int) -> str:
    def f(d: str) -> str:
        return f"exp(-(({d}) / {kappa}) * (({d}) / {kappa})) * ({d})" if option == 1 else f"1 / (1 + (({d}) / {kappa}) * (({d}) / {kappa})) * ({d})"

    for _ in range(steps):
        a = f"SELECT *, CASE WHEN y = ny - 1 THEN 0 ELSE lead(z) OVER {_w('y')} - z END AS ds, CASE WHEN x = nx - 1 THEN 0 ELSE lead(z) OVER {_w('x')} - z END AS de FROM ({src})"
        b = f"SELECT * EXCLUDE (ds, de), {f('ds')} AS fs, {f('de')} AS fe FROM ({a})"
        c = f"SELECT *, CASE WHEN y = 0 THEN fs ELSE fs - lag(fs) OVER {_w('y')} END AS ns, CASE WHEN x = 0 THEN fe ELSE fe - lag(fe) OVER {_w('x')} END AS ew FROM ({b})"
        src = f"SELECT raster_id, y, x, z + 0.1::DOUBLE * CASE WHEN ns IS NULL AND ew IS NULL THEN NULL ELSE coalesce(ns, 0) + coalesce(ew, 0) END AS z, ny, nx FROM ({c})"
    return src


_NEAR = "(VALUES (1,-1,1),(2,-1,0),(3,-1,-1),(4,0,-1),(5,1,-1),(6,1,0),(7,1,1),(8,0,1)) o(code, dy, dx)"


def _d8(src: str) -> str:
    return f"""SELECT c.raster_id, c.y, c.x, c.z, c.ny, c.nx, CASE WHEN c.z IS NULL THEN NULL WHEN b.code IS NOT NULL THEN b.code
        WHEN c.y = 0 THEN -2 WHEN c.y = c.ny - 1 THEN -6 WHEN c.x = 0 THEN -4 WHEN c.x = c.nx - 1 THEN -8 ELSE 0 END AS fdr
        FROM ({src}) c LEFT JOIN (SELECT c.y, c.x, o.code, row_number() OVER (PARTITION BY c.y, c.x ORDER BY (c.z - n.z) / CASE WHEN o.dy <> 0 AND o.dx <> 0 THEN sqrt(2) ELSE 1 END DESC, o.code) AS k
        FROM ({src}) c, {_NEAR}, ({src}) n WHERE n.y = c.y + o.dy AND n.x = c.x + o.dx AND n.z < c.z) b ON b.y = c.y AND b.x = c.x AND b.k = 1"""


def _accumulated(src: str) -> str:
    """Every cell with what drains through it and the cell it ends in."""
    return f"""WITH RECURSIVE d AS MATERIALIZED ({_d8(src)}), p AS (SELECT d.*, y + o.dy AS ty, x + o.dx AS tx FROM d LEFT JOIN {_NEAR} ON o.code = d.fdr),
        walk(sy, sx, y, x) AS (SELECT y, x, y, x FROM p UNION ALL SELECT w.sy, w.sx, p.ty, p.tx FROM walk w JOIN p ON p.y = w.y AND p.x = w.x WHERE p.ty IS NOT NULL),
        f AS (SELECT y, x, count(*) AS fac FROM walk GROUP BY y, x),
        r AS (SELECT w.sy AS y, w.sx AS x, CAST(w.y AS BIGINT) * p.nx + w.x + 1 AS basin FROM walk w JOIN p ON p.y = w.y AND p.x = w.x WHERE p.ty IS NULL),
        a AS (SELECT p.raster_id, p.y, p.x, p.z, p.ny, p.nx, p.fdr, f.fac, r.basin FROM p JOIN f USING (y, x) JOIN r USING (y, x)) """


# Sources and statistics -----------------------------------------------------------------------------------------------

@query("dem_scan", f"SELECT raster_id, y, x, z FROM ({EMB})")
def dem_scan(spark, d):
    return rasters.embeddings(spark, d).select("raster_id", "y", "x", "z")


@query("dem_nodata_mask", f"SELECT raster_id, y, x, CASE WHEN z >= 25 THEN z END AS z FROM ({LI})")
def dem_nodata_mask(spark, d):
    return rasters.lineitem(spark, d).select("raster_id", "y", "x", algebra.mask_nodata("z", 25.0).alias("z"))


def _three(spark, d):
    return rasters.embeddings(spark, d).unionByName(rasters.lineitem(spark, d)).unionByName(rasters.formed(spark, "y"))


_THREE = f"SELECT * FROM ({EMB}) UNION ALL SELECT * FROM ({LI}) UNION ALL SELECT * FROM ({_form('y')})"


@query("multi_raster_stats", f"SELECT raster_id, count(*) AS n, count(z) AS n_valid, round(min(z), 6) + 0.0 AS lo, round(max(z), 6) + 0.0 AS hi, round(avg(z), 6) + 0.0 AS mean, round(stddev_pop(z), 6) + 0.0 AS std FROM ({_THREE}) GROUP BY raster_id")
def multi_raster_stats(spark, d):
    return _out(stats.summary(_three(spark, d), "z"), "raster_id", "n", "n_valid", lo="min", hi="max", mean="mean", std="std")


@query("geotiff_round_trip", f"SELECT raster_id, y, x, z, CAST(ny AS INT) AS ny, CAST(nx AS INT) AS nx FROM ({LI})")
def geotiff_round_trip(spark, d):
    cells = rasters.lineitem(spark, d)

    def back(batches):
        for b in batches:
            for rid, data in zip(b["raster_id"], b["content"]):
                v = geotiff.decode(bytes(data)).values
                yield pd.DataFrame([(rid, y, x, float(z), *v.shape) for (y, x), z in __import__("numpy").ndenumerate(v)], columns=["raster_id", "y", "x", "z", "ny", "nx"])

    return geotiff.encoded(cells, "z", GT).mapInPandas(back, geotiff.CELLS).withColumn("z", F.when(~F.isnan("z"), F.col("z")))


@query("directory_stream", f"SELECT raster_id, count(*) AS n, count(z) AS n_valid, min(z) AS lo, max(z) AS hi FROM ({LI}) GROUP BY raster_id")
def directory_stream(spark, d):
    from ..streaming.directory import run_available, stream_cells

    at = f"{shared_dir(spark).removeprefix('file://')}/stream-{uuid.uuid4().hex}"
    geotiff.write(rasters.lineitem(spark, d), f"{at}/in", "z", gt=GT)
    run_available(stream_cells(spark, f"file://{at}/in"), lambda c: stats.summary(c, "z").select("raster_id", "n", "n_valid", F.col("min").alias("lo"), F.col("max").alias("hi")), f"file://{at}/out", f"file://{at}/state")
    return spark.read.parquet(f"file://{at}/out").drop("batch")


_RANKED = f"SELECT raster_id, z AS v, row_number() OVER (PARTITION BY raster_id ORDER BY z) AS k, count(*) OVER (PARTITION BY raster_id) AS n FROM ({EMB}) WHERE z IS NOT NULL"


def _quantile_sql(a: str, b: str) -> str:
    at = f"greatest(1.0::DOUBLE, least(n::DOUBLE, ({a})::DOUBLE + (n + ({b})::DOUBLE) * p))"
    return (f"SELECT raster_id, p, round(sum(v * CASE WHEN k = floor(place) THEN 1 - (place - floor(place)) ELSE place - floor(place) END), 6) + 0.0 AS q FROM (SELECT *, {at} AS place FROM ({_RANKED}), "
            f"(VALUES (0.001::DOUBLE), (0.25::DOUBLE), (0.9::DOUBLE), (0.999::DOUBLE)) t(p)) WHERE k = floor(place) OR (k = floor(place) + 1 AND place > floor(place)) GROUP BY raster_id, p")


for _kind, (_a, _b) in {4: ("0", "0"), 5: ("0.5", "0"), 6: ("0", "1"), 7: ("1", "-1"), 8: ("1.0::DOUBLE/3", "1.0::DOUBLE/3"), 9: ("0.375", "0.25"), "m": ("0.4", "0.2"), "matlab": ("0.5", "0")}.items():
    @query(f"quantile_{_kind}", _quantile_sql(_a, _b))
    def quantile_(spark, d, kind=_kind):
        return _out(stats.quantiles(rasters.embeddings(spark, d), "z", [0.001, 0.25, 0.9, 0.999], kind), "raster_id", "p", q="q")

for _kind, _at in {1: "ceil(n * p)", 2: "ceil(n * p + 0.5)", 3: "floor(n * p)"}.items():
    @query(f"quantile_{_kind}", f"SELECT raster_id, p, round(v, 6) + 0.0 AS q FROM ({_RANKED}), (VALUES (0.001::DOUBLE), (0.25::DOUBLE), (0.9::DOUBLE), (0.999::DOUBLE)) t(p) WHERE k = greatest(1, least(n, {_at}))")
    def quantile_discrete(spark, d, kind=_kind):
        return _out(stats.quantiles(rasters.embeddings(spark, d), "z", [0.001, 0.25, 0.9, 0.999], kind), "raster_id", "p", q="q")


@query("edge_threshold_mquantile", _quantile_sql("0.4", "0.2").replace(EMB, f"SELECT raster_id, y, x, slope AS z FROM ({_slope(EMB)})").replace("(0.001::DOUBLE), (0.25::DOUBLE), (0.9::DOUBLE), (0.999::DOUBLE)", "(0.9::DOUBLE)").replace("SELECT raster_id, p, round", "SELECT raster_id, round").replace("AS q", "AS kappa"))
def edge_threshold_mquantile(spark, d):
    return _out(pipeline.edge_threshold(rasters.embeddings(spark, d)), "raster_id", kappa="kappa")


@query("large_quantile", "SELECT q FROM (" + _quantile_sql("0.4", "0.2") + ") WHERE p = 0.9")
def large_quantile(spark, d):
    q = stats.large_quantile(rasters.embeddings(spark, d), "z", 0.9, "m", most=5000)
    return spark.range(1).select(_r(F.lit(q)).alias("q"))


@query("slope_stats", f"SELECT raster_id, round(degrees(atan(quantile_cont(slope, 0.001))), 6) + 0.0 AS low_deg, round(degrees(atan(quantile_cont(slope, 0.999))), 6) + 0.0 AS high_deg, round(avg(slope), 6) + 0.0 AS mean, round(stddev_pop(slope), 6) + 0.0 AS std FROM ({_slope(EMB)}) GROUP BY raster_id")
def slope_stats(spark, d):
    g = stencil.slope(rasters.embeddings(spark, d)).groupBy("raster_id").agg(
        F.degrees(F.atan(F.percentile("slope", 0.001))).alias("a"), F.degrees(F.atan(F.percentile("slope", 0.999))).alias("b"), F.avg("slope").alias("m"), F.stddev_pop("slope").alias("s"))
    return _out(g, "raster_id", low_deg="a", high_deg="b", mean="m", std="s")


@query("histogram_values", f"WITH s AS (SELECT min(z) AS lo, max(z) AS hi FROM ({EMB})), c AS (SELECT CAST(least(19, floor((z - lo) / ((hi - lo) / 20))) AS INT) AS bin, count(*) AS n FROM ({EMB}), s GROUP BY 1) "
       "SELECT 'emb' AS raster_id, CAST(i AS INT) AS bin, round(lo + i * ((hi - lo) / 20), 6) + 0.0 AS low, round(lo + (i + 1) * ((hi - lo) / 20), 6) + 0.0 AS high, coalesce(n, 0) AS count FROM s, range(0, 20) t(i) LEFT JOIN c ON c.bin = t.i")
def histogram_values(spark, d):
    return _out(stats.histogram(rasters.embeddings(spark, d), "z", 20), "raster_id", "bin", "count", low="low", high="high")


def _ratio(of: tuple, x: str) -> str:
    over, under = ("".join("(" for _ in part[1:]) + f"{part[0]!r}::DOUBLE" + "".join(f" * ({x}) + {c!r}::DOUBLE)" for c in part[1:]) for part in of)
    return f"{over} / {under}"


_TAIL = f"CASE WHEN r <= 5 THEN {_ratio(stats.MIDDLE, 'r - 1.6::DOUBLE')} ELSE {_ratio(stats.FAR, 'r - 5')} END"


@query("qq_plot", f"WITH s AS (SELECT raster_id, v AS ordered, k, n, CASE WHEN k = n THEN pow(0.5::DOUBLE, 1.0::DOUBLE / n) WHEN k = 1 THEN 1 - pow(0.5::DOUBLE, 1.0::DOUBLE / n) ELSE (k - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM ({_RANKED})), "
       "t AS (SELECT *, p - 0.5::DOUBLE AS q, sqrt(-ln(least(p, 1 - p))) AS r FROM s), "
       f"u AS (SELECT *, CASE WHEN abs(q) <= 0.425::DOUBLE THEN {_ratio(stats.CENTRE, '0.180625::DOUBLE - q * q')} * q WHEN q < 0 THEN -({_TAIL}) ELSE {_TAIL} END AS theoretical FROM t) "
       "SELECT raster_id, CAST(k AS INT) AS k, round(ordered, 6) + 0.0 AS ordered, round(theoretical, 6) + 0.0 AS theoretical, round(regr_slope(ordered, theoretical) OVER (PARTITION BY raster_id), 6) + 0.0 AS slope, "
       "round(regr_intercept(ordered, theoretical) OVER (PARTITION BY raster_id), 6) + 0.0 AS intercept FROM u")
def qq_plot(spark, d):
    return _out(stats.qq_points(rasters.embeddings(spark, d), "z"), "raster_id", "k", ordered="ordered", theoretical="theoretical", slope="slope", intercept="intercept")


# Stencils -------------------------------------------------------------------------------------------------------------

@query("gradient_xy", f"SELECT raster_id, y, x, round(gy, 6) + 0.0 AS gy, round(gx, 6) + 0.0 AS gx FROM ({_grad(LI)})")
def gradient_xy(spark, d):
    return _out(stencil.gradient(rasters.lineitem(spark, d)), "raster_id", "y", "x", gy="gy", gx="gx")


@query("slope_magnitude", f"SELECT raster_id, y, x, round(slope, 6) + 0.0 AS slope FROM ({_slope(EMB)})")
def slope_magnitude(spark, d):
    return _out(stencil.slope(rasters.embeddings(spark, d)), "raster_id", "y", "x", slope="slope")


for _m in ("geometric", "laplacian"):
    @query(f"curvature_{_m}", f"SELECT raster_id, y, x, round(curv, 6) + 0.0 AS curv FROM ({_curv(EMB, _m == 'geometric')})")
    def curvature_(spark, d, method=_m):
        return _out(stencil.curvature(rasters.embeddings(spark, d), method=method), "raster_id", "y", "x", curv="curv")


@query("curvature_stats", f"SELECT raster_id, round(avg(curv), 6) + 0.0 AS mean, round(stddev_pop(curv), 6) + 0.0 AS std FROM ({_curv(LI)}) GROUP BY raster_id")
def curvature_stats(spark, d):
    return _out(stats.summary(stencil.curvature(rasters.lineitem(spark, d)), "curv"), "raster_id", mean="mean", std="std")


for _name, _opt, _steps in (("diffusion_pm2_1iter", 2, 1), ("diffusion_pm1_1iter", 1, 1), ("diffusion_pm2_3iter", 2, 3)):
    @query(_name, f"SELECT raster_id, y, x, round(z, 6) + 0.0 AS z FROM ({_diffused(LI, '8.0::DOUBLE', _opt, _steps)})")
    def diffusion_(spark, d, option=_opt, steps=_steps):
        return _out(stencil.diffuse_sql(rasters.lineitem(spark, d), steps=steps, kappa=8.0, option=option), "raster_id", "y", "x", z="z")


@query("diffusion_kernel_3iter", ORACLE_SQL["diffusion_pm2_3iter"])
def diffusion_kernel_3iter(spark, d):
    return _out(stencil.diffuse(rasters.lineitem(spark, d), 3, 8.0, rows=16), "raster_id", "y", "x", z="z")


@query("diffusion_kernel_30iter", f"SELECT raster_id, y, x, round(z, 6) + 0.0 AS z FROM ({_diffused(EMB, '0.2::DOUBLE', 2, 30)})")
def diffusion_kernel_30iter(spark, d):
    return _out(stencil.diffuse(rasters.embeddings(spark, d), 30, 0.2), "raster_id", "y", "x", z="z")


def _padded(axis: str) -> str:
    n = f"n{axis}"
    return f"(SELECT {axis}, i, src, w FROM (SELECT DISTINCT {axis}, {n} FROM r), range(-2, 3) o(i), LATERAL (SELECT unnest(CASE WHEN {axis} + i < 0 THEN [0, 1] WHEN {axis} + i >= {n} THEN [{n} - 2, {n} - 1] ELSE [{axis} + i] END) AS src, CASE WHEN {axis} + i < 0 OR {axis} + i >= {n} THEN 0.5 ELSE 1.0 END AS w))"


@query("gaussian_smooth_5x5", f"WITH r AS MATERIALIZED ({_form('val')}), k AS (SELECT sum(exp(-(a.i * a.i + b.i * b.i) / 2.0)) AS total FROM range(-2, 3) a(i), range(-2, 3) b(i)) "
       f"SELECT 'val' AS raster_id, a.y, b.x, round(sum(exp(-(a.i * a.i + b.i * b.i) / 2.0) / k.total * a.w * b.w * s.z), 6) + 0.0 AS z FROM {_padded('y')} a, {_padded('x')} b, r s, k WHERE s.y = a.src AND s.x = b.src GROUP BY a.y, b.x")
def gaussian_smooth_5x5(spark, d):
    return _out(stencil.smooth(rasters.formed(spark, "val"), 1.0, rows=32), "raster_id", "y", "x", z="z")


_AT = {1: (-1, 1), 2: (-1, 0), 3: (-1, -1), 4: (0, -1), 5: (1, -1), 6: (1, 0), 7: (1, 1), 8: (0, 1)}


@query("neighbour_gather", f"WITH li AS MATERIALIZED ({LI}) SELECT c.raster_id, c.y, c.x, " + ", ".join(f"n{k}.z AS n{k}" for k in _AT) + " FROM li c " + " ".join(f"LEFT JOIN li n{k} ON n{k}.y = c.y + ({dy}) AND n{k}.x = c.x + ({dx})" for k, (dy, dx) in _AT.items()))
def neighbour_gather(spark, d):
    return stencil.neighbours(rasters.lineitem(spark, d)).select("raster_id", "y", "x", *[f"n{k}" for k in _AT])


@query("difference_next", f"SELECT raster_id, y, x, round(lead(z) OVER {_w('x')} - z, 6) + 0.0 AS d FROM ({EMB})")
def difference_next(spark, d):
    return _out(rasters.embeddings(spark, d).withColumn("d", F.lead("z").over(stencil.along()) - F.col("z")), "raster_id", "y", "x", d="d")


@query("diffusion_catte")
def diffusion_catte(spark, d):
    return _out(stencil.stencil_apply(rasters.embeddings(spark, d), stencil.catte_kernel(5, 0.2, 0.1, 0.5, "perona_malik_2"), 30), "raster_id", "y", "x", z="z")


# Cell-wise algebra ----------------------------------------------------------------------------------------------------

@query("skeleton_single", f"SELECT raster_id, y, x, CASE WHEN z > 40 THEN 1 ELSE 0 END AS skel FROM ({LI})")
def skeleton_single(spark, d):
    return rasters.lineitem(spark, d).select("raster_id", "y", "x", algebra.single_threshold("z", 40.0).alias("skel"))


@query("skeleton_dual", f"WITH c AS (SELECT *, coalesce({_d('gy', 'y')} + {_d('gx', 'x')}, 0) AS curv FROM ({_grad(EMB)})), m AS (SELECT avg(curv) + stddev_pop(curv) AS t FROM c) SELECT raster_id, y, x, CASE WHEN curv > t AND abs(z) > 0.05 THEN 1 ELSE 0 END AS skel FROM c, m")
def skeleton_dual(spark, d):
    x = stencil.curvature(rasters.embeddings(spark, d), method="laplacian").withColumn("flow", F.abs("z"))
    x = algebra.with_stats(x, "curv", t=F.avg("curv") + F.stddev_pop("curv"))
    return x.select("raster_id", "y", "x", algebra.dual_threshold("curv", "flow", F.col("t"), 0.05).alias("skel"))


@query("layer_normalized", f"SELECT raster_id, y, x, round((z - min(z) OVER ()) / nullif(max(z) OVER () - min(z) OVER (), 0), 6) + 0.0 AS z FROM ({LI})")
def layer_normalized(spark, d):
    return _out(algebra.normalized(rasters.lineitem(spark, d), "z"), "raster_id", "y", "x", z="z")


def _cost_layers(spark, d):
    x = rasters.embeddings(spark, d)
    return x.select("raster_id", "y", "x", (F.abs("z") * 100).alias("flow"), (F.col("z") > 0.1).cast("int").alias("skel"), F.col("z").alias("curv"), (F.abs("z") + 0.5).alias("slope"))


_COST = f"SELECT raster_id, y, x, abs(z) * 100 AS flow, CASE WHEN z > 0.1::DOUBLE THEN 1 ELSE 0 END AS skel, z AS curv, abs(z) + 0.5 AS slope, avg(abs(z) * 100) OVER () AS flow_mean FROM ({EMB})"

for _name, _e in {"local_cost_default": "flow + flow_mean * skel + flow_mean * curv", "local_cost_exp": "flow + 30 * skel + exp(3 * curv)", "local_cost_power": "cbrt(flow) / cbrt(slope) + 20"}.items():
    @query(_name, f"SELECT raster_id, y, x, round({_e}, 5) + 0.0 AS cost FROM ({_COST})")
    def local_cost_(spark, d, expression=_e):
        return algebra.local_cost(_cost_layers(spark, d), expression).select("raster_id", "y", "x", _r("cost", 5).alias("cost"))


@query("predefined_heads", f"SELECT raster_id, y, x FROM ({LI}) WHERE z = 50")
def predefined_heads(spark, d):
    return tables.heads_from(rasters.lineitem(spark, d).withColumn("z", (F.col("z") == 50).cast("double")))


@query("finite_cells", f"SELECT raster_id, y, x, coalesce(z, 0) AS z, z IS NOT NULL AS valid FROM ({LI})")
def finite_cells(spark, d):
    return rasters.lineitem(spark, d).select("raster_id", "y", "x", F.coalesce("z", F.lit(0.0)).alias("z"), algebra.finite("z").alias("valid"))


@query("masked_layer", f"SELECT raster_id, y, x, CASE WHEN z IS NOT NULL AND z >= 25 THEN z * 2 END AS flow FROM ({LI})")
def masked_layer(spark, d):
    x = rasters.lineitem(spark, d).withColumn("flow", F.col("z") * 2).withColumn("z", algebra.mask_nodata("z", 25.0))
    return x.select("raster_id", "y", "x", algebra.mask_by("flow", "z").alias("flow"))


# Flow -----------------------------------------------------------------------------------------------------------------

@query("d8_direction", f"SELECT raster_id, y, x, CAST(fdr AS INT) AS fdr FROM ({_d8('SELECT * FROM li')})".join([f"WITH li AS MATERIALIZED ({LI}) ", ""]))
def d8_direction(spark, d):
    return flow.d8_direction(rasters.lineitem(spark, d)).select("raster_id", "y", "x", "fdr")


def _accumulate(spark, name):
    return flow.accumulation(stored(flow.d8_direction(rasters.formed(spark, name)), "directions"))


@query("flow_accumulation_d8", _accumulated(_form("y")) + "SELECT raster_id, y, x, CAST(fac AS BIGINT) AS fac FROM a")
def flow_accumulation_d8(spark, d):
    return _accumulate(spark, "y").select("raster_id", "y", "x", "fac")


@query("basins_d8", _accumulated(_form("2b")) + "SELECT raster_id, y, x, basin FROM a")
def basins_d8(spark, d):
    return _accumulate(spark, "2b").select("raster_id", "y", "x", "basin")


@query("outlet_points", _accumulated(_form("2b")) + f"SELECT raster_id, y, x, CAST(row_number() OVER (ORDER BY y, x) AS INT) AS cat, {GT[0]} + {GT[1]} * (x + 0.5) AS x_proj, {GT[3]} + {GT[5]} * (y + 0.5) AS y_proj FROM a WHERE fdr < 0")
def outlet_points(spark, d):
    p = algebra.to_points(flow.d8_direction(rasters.formed(spark, "2b")), "fdr < 0", "outlet")
    return p.select("raster_id", "y", "x", "cat", algebra.map_x(F.col("x"), GT[0], GT[1], True).alias("x_proj"), algebra.map_y(F.col("y"), GT[3], GT[5], True).alias("y_proj"))


@query("basin_area_pct", _accumulated(_form("2b")) + f"SELECT raster_id, basin, count(*) AS n_cells, round(100.0 * count(*) / {NY * NX}, 6) + 0.0 AS percent FROM a GROUP BY raster_id, basin")
def basin_area_pct(spark, d):
    return _out(flow.basin_area(_accumulate(spark, "2b")), "raster_id", "basin", "n_cells", percent="percent")


@query("fmm_start_points", _accumulated(_form("2b")) + f"SELECT raster_id, y, x, basin, n_cells FROM a JOIN (SELECT basin, count(*) AS n_cells FROM a GROUP BY basin HAVING 100.0 * count(*) / {NY * NX} > 0.5 AND count(*) > 6) USING (basin) WHERE fdr < 0")
def fmm_start_points(spark, d):
    return flow.start_points(_accumulate(spark, "2b")).select("raster_id", "y", "x", "basin", "n_cells")


@query("outlets_csv_rows", _accumulated(_form("2b")) + "SELECT raster_id, basin AS BasinID, y AS YIndex, x AS XIndex FROM a WHERE fdr < 0")
def outlets_csv_rows(spark, d):
    return tables.outlet_rows(flow.outlets(_accumulate(spark, "2b")))


@query("skeleton_flow", _accumulated(_form("y")) + "SELECT raster_id, y, x, CASE WHEN fac > 50 THEN 1 ELSE 0 END AS skel FROM a")
def skeleton_flow(spark, d):
    return _accumulate(spark, "y").select("raster_id", "y", "x", algebra.single_threshold("fac", 50).alias("skel"))


@query("flow_priority_flood")
def flow_priority_flood(spark, d):
    return flow.accumulation(stored(flow.priority_flood(rasters.lineitem(spark, d)), "flood")).select("raster_id", "y", "x", "fdr", "level", "fac", "basin")


@query("flow_accumulation_mfd", f"""WITH RECURSIVE r AS MATERIALIZED ({_form('y')}),
    s AS (SELECT c.y, c.x, n.y AS ty, n.x AS tx, pow((c.z - n.z) / CASE WHEN o.dy <> 0 AND o.dx <> 0 THEN sqrt(2) ELSE 1 END, 1.1::DOUBLE) AS share FROM r c, {_NEAR}, r n WHERE n.y = c.y + o.dy AND n.x = c.x + o.dx AND n.z < c.z),
    w AS MATERIALIZED (SELECT y, x, ty, tx, share / sum(share) OVER (PARTITION BY y, x) AS part FROM s),
    walk(step, y, x, water) AS (SELECT 0, y, x, 1.0::DOUBLE FROM r UNION ALL SELECT step, y, x, water FROM (SELECT any_value(a.step) + 1 AS step, w.ty AS y, w.tx AS x, sum(a.water * w.part) AS water FROM walk a JOIN w ON w.y = a.y AND w.x = a.x GROUP BY w.ty, w.tx))
    SELECT 'y' AS raster_id, y, x, round(sum(water), 4) + 0.0 AS mfd FROM walk GROUP BY y, x""")
def flow_accumulation_mfd(spark, d):
    """On a raster without pits, whose levels are its elevations."""
    return flow.priority_flood(rasters.formed(spark, "y"), accumulate_mfd=True).select("raster_id", "y", "x", _r("mfd", 4).alias("mfd"))


# Skeleton to network --------------------------------------------------------------------------------------------------

def _skeleton(spark, d, t=49.0):
    return network.label_components(rasters.lineitem(spark, d).withColumn("skel", algebra.single_threshold("z", t)).withColumn("geo", ((F.col("y") * 31 + F.col("x") * 17) % 101).cast("double")))


_LABELS = f"""WITH RECURSIVE li AS MATERIALIZED ({LI}), s AS MATERIALIZED (SELECT y, x, y * 64 + x AS id FROM li WHERE z > 49),
    e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM s a JOIN s b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.id <> b.id),
    reach(id, root) AS (SELECT id, id FROM s UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.id AND r.root < e.b),
    m AS MATERIALIZED (SELECT id, min(root) AS root FROM reach GROUP BY id),
    l AS MATERIALIZED (SELECT s.y, s.x, dense_rank() OVER (ORDER BY root) AS label FROM m JOIN s USING (id)),
    z AS MATERIALIZED (SELECT label, count(*) AS n_cells FROM l GROUP BY label),
    rk AS (SELECT n_cells, row_number() OVER (ORDER BY n_cells DESC, label DESC) AS k FROM z),
    h AS (SELECT (SELECT count(*) FROM z) AS n, min(n_cells)::DOUBLE AS lo0, max(n_cells)::DOUBLE AS hi0 FROM rk WHERE k > 1),
    h2 AS (SELECT n, floor(sqrt(n)) AS bins, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM h),
    t AS MATERIALIZED (SELECT n, CASE WHEN bins >= 2 THEN lo + 2 * ((hi - lo) / bins) ELSE (SELECT min(n_cells)::DOUBLE FROM z) END AS threshold FROM h2) """


@query("component_labels", _LABELS + "SELECT 'li' AS raster_id, li.y, li.x, CAST(coalesce(l.label, 0) AS INT) AS label FROM li LEFT JOIN l USING (y, x)")
def component_labels(spark, d):
    return _skeleton(spark, d).select("raster_id", "y", "x", "label")


@query("component_sizes", _LABELS + "SELECT 'li' AS raster_id, CAST(label AS INT) AS label, n_cells FROM z")
def component_sizes(spark, d):
    return network.component_sizes(_skeleton(spark, d))


@query("component_threshold", _LABELS + "SELECT 'li' AS raster_id, n AS n_labels, round(threshold, 6) + 0.0 AS threshold FROM t")
def component_threshold(spark, d):
    return _out(network.size_threshold(network.component_sizes(_skeleton(spark, d))), "raster_id", "n_labels", threshold="threshold")


@query("channel_heads", _LABELS + """, c AS MATERIALIZED (SELECT l.y, l.x, l.label, CAST((l.y * 31 + l.x * 17) % 101 AS DOUBLE) AS geo, n_cells >= (SELECT threshold FROM t) AS big FROM l JOIN z USING (label))
    SELECT 'li' AS raster_id, CAST(a.label AS INT) AS label, a.y, a.x, a.geo FROM c a WHERE a.big AND NOT EXISTS (SELECT 1 FROM c b WHERE b.label = a.label AND b.geo > a.geo
    AND b.y BETWEEN greatest(a.y - 25, 1) AND a.y + 24 AND b.x BETWEEN greatest(a.x - 25, 1) AND a.x + 24)""")
def channel_heads(spark, d):
    return network.channel_heads(_skeleton(spark, d)).select("raster_id", "label", "y", "x", "geo")


_HEADS = ((90, 5), (80, 60), (50, 32), (95, 64))


def _paths(spark):
    cells = rasters.formed(spark, "val").withColumn("geo", F.col("z")).withColumn("basin", F.lit(1).cast("long"))
    heads = spark.createDataFrame([("val", y, x) for y, x in _HEADS], "raster_id string, y int, x int")
    return network.paths(cells, heads)


_PATHS = f"""WITH RECURSIVE r AS MATERIALIZED (SELECT y, x, CASE WHEN z = 0 THEN 'inf'::DOUBLE ELSE z END AS g FROM ({_form('val')})),
    o AS (SELECT * FROM (VALUES (0,1,0),(1,-1,0),(2,0,1),(3,0,-1),(4,1,1),(5,-1,-1),(6,1,-1),(7,-1,1)) t(k, dy, dx)),
    nb AS MATERIALIZED (SELECT a.y, a.x, o.k, b.y AS ty, b.x AS tx, b.g, CASE WHEN o.k >= 4 THEN sqrt(2) ELSE 1 END AS far, min(b.g) OVER (PARTITION BY a.y, a.x) AS least FROM r a, o, r b WHERE b.y = a.y + o.dy AND b.x = a.x + o.dx),
    h AS (SELECT row_number() OVER (ORDER BY y, x) AS path_id, y, x FROM (VALUES {', '.join(map(str, _HEADS))}) t(y, x)),
    w(path_id, seq, y, x, level) AS (SELECT h.path_id, 0, r.y, r.x, r.g FROM h JOIN r USING (y, x)
      UNION ALL SELECT path_id, seq, y, x, level FROM (SELECT w.path_id, w.seq + 1 AS seq, nb.ty AS y, nb.tx AS x, nb.least AS level, row_number() OVER (PARTITION BY w.path_id ORDER BY (w.level - nb.g) / nb.far DESC, nb.k) AS pick
        FROM w JOIN nb ON nb.y = w.y AND nb.x = w.x WHERE nb.least <= w.level AND w.seq < 400) WHERE pick = 1) """


@query("geodesic_paths", _PATHS + "SELECT 'val' AS raster_id, CAST(path_id AS INT) AS path_id, CAST(seq AS INT) AS seq, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM w")
def geodesic_paths(spark, d):
    return _paths(spark)


@query("visit_counts", _PATHS + "SELECT 'val' AS raster_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, count(*) AS n_paths FROM w GROUP BY y, x")
def visit_counts(spark, d):
    return network.visit_counts(_paths(spark))


# A path ends where it meets a cell that begins a reach already; other changes of the number of paths are junctions.
_REACHES = _PATHS + f""", v AS MATERIALIZED (SELECT path_id, seq, y, x, CAST(y AS BIGINT) * {NX} + x AS id, count(*) OVER (PARTITION BY y, x) AS n FROM w),
    c AS (SELECT *, n <> lag(n) OVER (PARTITION BY path_id ORDER BY seq) AS turn FROM v),
    g AS MATERIALIZED (SELECT path_id, min(id) FILTER (seq = 0) AS head, coalesce(list(id ORDER BY seq) FILTER (turn), []) AS ids, coalesce(list(seq ORDER BY seq) FILTER (turn), []) AS seqs FROM c GROUP BY path_id),
    st(path_id, starts, seqs, stop, before) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(0 AS BIGINT)
      UNION ALL SELECT path_id, list_concat(starts, list_prepend(head, ids[1:k - 1])), CAST(seqs[1:k - 1] AS BIGINT[]), CAST(seqs[k] AS BIGINT), before
        FROM (SELECT g.path_id, st.starts, g.head, g.ids, g.seqs, coalesce(list_filter(range(1, len(g.ids) + 1), lambda i: list_contains(list_append(st.starts, g.head), g.ids[i]))[1], len(g.ids) + 1) AS k,
              st.before + CASE WHEN st.path_id = 0 THEN 0 ELSE len(st.seqs) + 1 END AS before FROM st JOIN g ON g.path_id = st.path_id + 1)),
    q AS (SELECT v.path_id, v.seq, v.y, v.x, st.seqs, st.before, len(list_filter(st.seqs, lambda s: s < v.seq)) AS j, list_contains(st.seqs, v.seq) AS junction FROM v JOIN st USING (path_id) WHERE st.stop IS NULL OR v.seq <= st.stop) """


@query("reach_segments", _REACHES + """SELECT 'val' AS raster_id, CAST(before + j + 1 AS INT) AS reach_id, CAST(seq - CASE WHEN j = 0 THEN 0 ELSE seqs[j] END AS INT) AS seq, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM q
    UNION ALL SELECT 'val', CAST(before + j + 2 AS INT), 0, CAST(y AS INT), CAST(x AS INT) FROM q WHERE junction""")
def reach_segments(spark, d):
    return network.reaches(_paths(spark)).filter("kind = 'reach'").select("raster_id", "reach_id", "seq", "y", "x")


@query("junctions", _REACHES + "SELECT 'val' AS raster_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM q WHERE junction")
def junctions(spark, d):
    return network.reaches(_paths(spark)).filter("kind = 'junction'").select("raster_id", "y", "x")


def _reach(spark):
    r = spark.range(180).select(F.lit("y").alias("raster_id"), (F.expr("id DIV 60") + 1).cast("int").alias("reach_id"), (F.col("id") % 60).cast("int").alias("seq"))
    return r.select("raster_id", "reach_id", "seq", (F.col("seq") + 20).alias("y"), F.expr("CAST(CASE reach_id WHEN 1 THEN 32 WHEN 2 THEN 10 + seq DIV 2 ELSE 60 - seq DIV 3 END AS INT)").alias("x"))


_SAMPLES = """WITH r AS (SELECT CAST(id // 60 + 1 AS INT) AS reach_id, CAST(id % 60 AS INT) AS seq, CAST(id % 60 + 20 AS DOUBLE) AS y, CAST(CASE id // 60 WHEN 0 THEN 32 WHEN 1 THEN 10 + (id % 60) // 2 ELSE 60 - (id % 60) // 3 END AS DOUBLE) AS x FROM range(0, 180) t(id)),
    s AS (SELECT c.reach_id, c.seq AS station, c.y, c.x, l.y AS ly, l.x AS lx, l.y - k.y AS dy, l.x - k.x AS dx, sqrt((l.x - k.x) * (l.x - k.x) + (l.y - k.y) * (l.y - k.y)) AS m
      FROM r c JOIN r l ON l.reach_id = c.reach_id AND l.seq = c.seq + 3 JOIN r k ON k.reach_id = c.reach_id AND k.seq = c.seq - 3 WHERE c.seq >= 5 AND c.seq < 55 AND c.seq % 5 = 0),
    a AS (SELECT *, CASE WHEN dx > 0 AND dy < 0 THEN -dy WHEN dx < 0 AND dy > 0 THEN dy ELSE abs(dy) END / m AS sn, CASE WHEN dx > 0 AND dy < 0 THEN -dx WHEN dx < 0 AND dy > 0 THEN dx ELSE abs(dx) END / m AS cs FROM s WHERE m > 0),
    b AS (SELECT *, (CASE WHEN sn < 0 THEN x - 20 * sn ELSE x + 20 * sn END - lx) * dy - (y - 20 * cs - ly) * dx > 0 AS turned FROM a),
    q AS (SELECT reach_id, station, CAST(i AS INT) AS t, y, x, sn, cs, CASE WHEN turned THEN -i ELSE i END AS u FROM b, range(-20, 21) t(i)) """


@query("cross_section_samples", _SAMPLES + "SELECT 'y' AS raster_id, reach_id, station, t, CAST(round(y + u * cs) AS INT) AS y, CAST(round(CASE WHEN sn < 0 THEN x + u * sn ELSE x - u * sn END) AS INT) AS x FROM q")
def cross_section_samples(spark, d):
    return network.section_samples(_reach(spark))


def _sections(spark):
    cells = stencil.slope(rasters.formed(spark, "y"))
    return cells, network.cross_sections(cells, _reach(spark))


@query("cross_section_values", _SAMPLES + f", p AS (SELECT reach_id, station, t, CAST(round(y + u * cs) AS INT) AS y, CAST(round(CASE WHEN sn < 0 THEN x + u * sn ELSE x - u * sn END) AS INT) AS x FROM q), v AS ({_slope(_form('y'))}) "
       "SELECT 'y' AS raster_id, reach_id, station, t, v.z IS NOT NULL AS valid, round(coalesce(v.z, 0), 6) + 0.0 AS elevation, round(coalesce(v.slope, 0), 6) + 0.0 AS slope FROM p LEFT JOIN v USING (y, x)")
def cross_section_values(spark, d):
    return _out(_sections(spark)[1], "raster_id", "reach_id", "station", "t", "valid", elevation="elevation", slope="slope")


# The middle of the first run of the greatest slopes on each side; the first place where all are equal.
_BANKS = _SAMPLES + f""", p AS (SELECT reach_id, station, t, CAST(round(y + u * cs) AS INT) AS y, CAST(round(CASE WHEN sn < 0 THEN x + u * sn ELSE x - u * sn END) AS INT) AS x FROM q), v AS MATERIALIZED ({_slope(_form('y'))}),
    e AS MATERIALIZED (SELECT reach_id, station, t, p.y, p.x, v.z IS NOT NULL AS valid, coalesce(v.z, 0) AS elevation, coalesce(v.slope, 0) AS slope FROM p LEFT JOIN v USING (y, x)),
    side AS (SELECT *, CASE WHEN t < 0 THEN 'left' WHEN t >= 2 THEN 'right' END AS side, bool_or(valid) OVER (PARTITION BY reach_id, station) AS known FROM e),
    best AS (SELECT *, max(slope) OVER (PARTITION BY reach_id, station, side) AS most, min(slope) OVER (PARTITION BY reach_id, station, side) AS least, t - CASE side WHEN 'left' THEN -20 ELSE 2 END AS pos FROM side WHERE side IS NOT NULL AND known),
    run AS (SELECT *, pos - row_number() OVER (PARTITION BY reach_id, station, side ORDER BY pos) AS r FROM best WHERE slope = most),
    place AS (SELECT reach_id, station, side, CASE WHEN any_value(most) = any_value(least) THEN min(pos) ELSE (min(pos) + max(pos)) // 2 END AS pos, row_number() OVER (PARTITION BY reach_id, station, side ORDER BY min(pos)) AS k FROM run GROUP BY reach_id, station, side, r),
    bank AS MATERIALIZED (SELECT reach_id, station, place.side, e.t, e.y, e.x, e.elevation, min(e.elevation) OVER (PARTITION BY reach_id, station) AS water_level FROM place JOIN e USING (reach_id, station) WHERE k = 1 AND e.t = place.pos + CASE place.side WHEN 'left' THEN -20 ELSE 2 END) """


@query("bank_points", _BANKS + "SELECT 'y' AS raster_id, reach_id, station, side, t, y, x, round(elevation, 6) + 0.0 AS elevation, round(water_level, 6) + 0.0 AS water_level FROM bank")
def bank_points(spark, d):
    return _out(network.bank_points(_sections(spark)[1]), "raster_id", "reach_id", "station", "side", "t", "y", "x", elevation="elevation", water_level="water_level")


@query("section_map", _BANKS + """, m AS (SELECT y, x, max(m) AS m FROM (SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x, 1 AS m FROM r UNION ALL SELECT y, x, 2 FROM e WHERE valid UNION ALL SELECT y, x, 3 FROM bank) GROUP BY y, x)
    SELECT 'y' AS raster_id, v.y, v.x, CAST(coalesce(m.m, CASE WHEN v.z IS NULL THEN 0 ELSE 999 END) AS INT) AS code FROM v LEFT JOIN m USING (y, x)""")
def section_map(spark, d):
    cells, s = _sections(spark)
    s = stored(s, "sections")
    return network.section_map(cells, _reach(spark), s, network.bank_points(s))


@query("local_extrema", "SELECT vec_id, CAST(list_max(embedding) AS DOUBLE) AS top, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS top_at, CAST(list_min(embedding) AS DOUBLE) AS low, CAST(list_position(embedding, list_min(embedding)) - 1 AS INT) AS low_at FROM embeddings")
def local_extrema_query(spark, d):
    @F.pandas_udf("struct<top:double,top_at:int,low:double,low_at:int>")
    def ends(v: pd.Series) -> pd.DataFrame:
        got = [local_extrema(a) for a in v]
        return pd.DataFrame([(a[0], b[0], c[0], e[0]) for a, b, c, e in got], columns=["top", "top_at", "low", "low_at"])

    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select("vec_id", ends(F.col("embedding").cast("array<double>")).alias("e")).select("vec_id", "e.*")


@query("export_points_wkt", ORACLE_SQL["channel_heads"].replace("SELECT 'li' AS raster_id, CAST(a.label AS INT) AS label, a.y, a.x, a.geo FROM c a", f"SELECT 'li' AS raster_id, 'ChannelHead' AS type, {GT[0]} + a.x AS x_proj, {GT[3]} - a.y AS y_proj, printf('POINT(%f %f)', {GT[0]} + a.x, {GT[3]} - a.y) AS geometry FROM c a"))
def export_points_wkt(spark, d):
    return tables.point_features(network.channel_heads(_skeleton(spark, d)), "ChannelHead", GT)


@query("export_lines_wkt", _SAMPLES + f"SELECT 'y' AS raster_id, reach_id, 'ChannelNetwork' AS type, 'LINESTRING(' || string_agg(printf('%f %f', {GT[0]} + x, {GT[3]} - y), ', ' ORDER BY seq) || ')' AS geometry FROM r GROUP BY reach_id")
def export_lines_wkt(spark, d):
    return tables.line_features(_reach(spark), ["raster_id", "reach_id"], "seq", "ChannelNetwork", GT)


@query("export_sections_wkt", _BANKS + f""", o AS (SELECT reach_id, station, min(t) AS a, max(t) AS b FROM e WHERE valid GROUP BY reach_id, station)
    SELECT 'y' AS raster_id, o.reach_id, o.station, 'CrossSection' AS type, 'LINESTRING(' || printf('%f %f', {GT[0]} + p.x, {GT[3]} - p.y) || ', ' || printf('%f %f', {GT[0]} + q.x, {GT[3]} - q.y) || ')' AS geometry,
    CAST(row_number() OVER (ORDER BY o.reach_id, o.station) AS INT) AS id FROM o JOIN e p ON p.reach_id = o.reach_id AND p.station = o.station AND p.t = o.a JOIN e q ON q.reach_id = o.reach_id AND q.station = o.station AND q.t = o.b""")
def export_sections_wkt(spark, d):
    return tables.section_features(_sections(spark)[1], GT)


@query("export_banks_wkt", _BANKS + f"SELECT 'y' AS raster_id, reach_id, side, 'Bank' AS type, 'LINESTRING(' || string_agg(printf('%f %f', {GT[0]} + x, {GT[3]} - y), ', ' ORDER BY station) || ')' AS geometry FROM bank GROUP BY reach_id, side")
def export_banks_wkt(spark, d):
    return tables.bank_features(network.bank_points(_sections(spark)[1]), GT)


@query("stream_csv_rows", _SAMPLES + "SELECT 'y' AS raster_id, reach_id AS ID, '[' || string_agg('[' || CAST(y AS INT) || ',' || CAST(x AS INT) || ']', ',' ORDER BY seq) || ']' AS PathCellList FROM r GROUP BY reach_id")
def stream_csv_rows(spark, d):
    return tables.stream_rows(_reach(spark))


@query("geodesic_fmm")
def geodesic_fmm(spark, d):
    x = _accumulate(spark, "2b").withColumn("flow", F.col("fac").cast("double")).withColumn("cost", F.col("flow") + 1)
    x = stored(x, "cost")
    return _out(network.geodesic(x, flow.start_points(x)), "raster_id", "y", "x", "basin", geo="geo")


def network_of(spark: SparkSession, sf_dir: str) -> pipeline.Network:
    cells = rasters.formed(spark, "y").unionByName(rasters.formed(spark, "2b")).unionByName(rasters.lineitem(spark, sf_dir))
    return pipeline.extract(cells, TerrainConfig())


@query("network_heads")
def network_heads(spark, d):
    return network_of(spark, d).heads.select("raster_id", "label", "y", "x", "geo")


_FILTERED = (f"WITH RECURSIVE r0 AS MATERIALIZED ({_form('y')}), ka AS MATERIALIZED (" + ORACLE_SQL["edge_threshold_mquantile"].replace(EMB, "SELECT * FROM r0").replace("round(sum(", "(sum(").replace(", 6) + 0.0 AS kappa", ") AS kappa")
             + "), r1 AS MATERIALIZED (SELECT r0.raster_id, y, x, z / kappa AS z, ny, nx FROM r0, ka), f0 AS MATERIALIZED (SELECT d.raster_id, y, x, z * kappa AS z, ny, nx FROM ("
             + _diffused("SELECT * FROM r1", "1.0::DOUBLE", 2, 30) + ") d, ka), ")


@query("network_layers", _FILTERED + _accumulated("SELECT * FROM f0").removeprefix("WITH RECURSIVE ") + f""", cv AS MATERIALIZED ({_curv("SELECT * FROM f0")}), sl AS ({_slope("SELECT * FROM f0")}),
    m AS (SELECT avg(curv) + stddev_pop(curv) AS t, min(curv) AS lo, max(curv) AS hi FROM cv),
    l AS (SELECT a.raster_id, a.y, a.x, a.z, sl.slope, cv.curv, a.fac::DOUBLE AS flow, a.fdr, a.basin, CASE WHEN a.fac > 50 THEN 1 ELSE 0 END AS flow_skel, CASE WHEN cv.curv > m.t THEN 1 ELSE 0 END AS curv_skel,
      coalesce((cv.curv - m.lo) / nullif(m.hi - m.lo, 0), 0) AS share, avg(a.fac) OVER () AS flow_mean FROM a JOIN cv USING (y, x) JOIN sl USING (y, x), m)
    SELECT raster_id, y, x, round(z, 6) + 0.0 AS z, round(slope, 6) + 0.0 AS slope, round(curv, 6) + 0.0 AS curvature, round(flow, 6) + 0.0 AS flow, round(flow + flow_mean * (flow_skel * curv_skel) + flow_mean * share, 6) + 0.0 AS cost,
    CAST(fdr AS INT) AS fdr, basin, flow_skel, curv_skel, flow_skel * curv_skel AS skel FROM l""")
def network_layers(spark, d):
    """Every layer of the extraction of one raster, up to the cost."""
    x, _ = pipeline.layers(rasters.formed(spark, "y"))
    return x.select("raster_id", "y", "x", *[_r(c).alias(c) for c in ("z", "slope", "curvature", "flow", "cost")], "fdr", "basin", "flow_skel", "curv_skel", "skel")


@query("network_extraction")
def network_extraction(spark, d):
    """Flagship: the channel network of several rasters in one plan."""
    return network_of(spark, d).reaches.select("raster_id", "kind", "reach_id", "seq", "y", "x")
