"""Terrain operators against plain NumPy, hand-made cases and invariants."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rillflow.config import TerrainConfig, generation
from rillflow.functions import algebra, stats
from rillflow.functions.extrema import local_extrema
from rillflow.operators import flow, network, stencil
from rillflow.plans import pipeline, rasters
from rillflow.sources import geotiff, tables


def cells(spark, a, name="t"):
    a = np.asarray(a, float)
    rows = [(name, y, x, None if np.isnan(v) else float(v), *a.shape) for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, geotiff.CELLS)


def grid(df, c):
    p = df.select("y", "x", c).toPandas()
    a = np.full((p["y"].max() + 1, p["x"].max() + 1), np.nan)
    a[p["y"], p["x"]] = p[c].astype(float)
    return a


def test_gradient_edges_go_by_position(spark):
    a = np.arange(20.0).reshape(4, 5) ** 1.5
    a[1, 2] = np.nan
    g = stencil.gradient(cells(spark, a), h=2.0).persist()
    gy, gx = np.gradient(a, 2.0)
    np.testing.assert_allclose(grid(g, "gy"), gy)
    np.testing.assert_allclose(grid(g, "gx"), gx)


def test_flat_raster_has_no_curvature_and_no_range(spark):
    flat = cells(spark, np.ones((8, 8)))
    assert (grid(stencil.curvature(flat), "curv") == 0).all()
    assert np.isnan(grid(algebra.normalized(flat, "z"), "z")).all()


def test_strips_equal_the_whole(spark):
    a = np.random.default_rng(1).normal(size=(57, 9))
    a[20, 3] = np.nan
    got = grid(stencil.diffuse(cells(spark, a), 7, 0.7, rows=16), "z")
    np.testing.assert_allclose(got, stencil.diffusion_kernel(7, 0.7, 0.1, 1.0, 2)(a), atol=1e-12)
    np.testing.assert_allclose(grid(stencil.diffuse_sql(cells(spark, a), steps=2, kappa=0.7), "z"), stencil.diffusion_kernel(2, 0.7, 0.1, 1.0, 2)(a), atol=1e-12)


@settings(max_examples=20, deadline=None)
@given(st.integers(0, 10_000))
def test_diffusion_keeps_mass_and_range(seed):
    a = np.random.default_rng(seed).normal(size=(9, 8))
    b = stencil.diffusion_kernel(20, 1.0, 0.1, 1.0, 1)(a)
    assert abs(a.sum() - b.sum()) < 1e-9 and b.max() <= a.max() + 1e-9 and b.min() >= a.min() - 1e-9


def test_nodata(spark):
    z = [[-9999.0, -10000.0, 3.0, float("nan")]]
    got = cells(spark, z).select(algebra.mask_nodata("z").alias("a"), algebra.mask_nodata("z", inclusive=True).alias("b")).collect()
    assert [r["a"] for r in got] == [-9999.0, None, 3.0, None] and [r["b"] for r in got] == [None, None, 3.0, None]


def test_accumulation_and_basins(spark):
    x = flow.accumulation(flow.d8_direction(rasters.formed(spark, "2b"))).persist()
    out = {(r["y"], r["x"]): r["fac"] for r in x.filter("fdr < 0").collect()}
    assert out == {(0, 16): 3118, (0, 48): 3122}
    assert x.filter("basin = 0").count() == 0
    assert {(r["y"], r["x"]) for r in flow.start_points(x).collect()} == set(out)


def test_priority_flood_leaves_no_pit():
    a = np.random.default_rng(3).normal(size=(25, 21))
    a[5, 5] = np.nan
    code, order, level = flow.flood(a)
    assert (code[~np.isnan(a)] != 0).all() and (level[~np.isnan(a)] >= a[~np.isnan(a)]).all()
    for y, x in np.argwhere(~np.isnan(a)):  # every way ends off the grid
        for _ in range(a.size + 1):
            if code[y, x] < 0:
                break
            dy, dx = algebra.OFFSETS[int(code[y, x])]
            y, x = y + dy, x + dx
        assert code[y, x] < 0
    acc = flow.multiple_flow(a, level, code, order)
    ends = code < 0
    assert acc[ends & ~np.isnan(a)].sum() == pytest.approx((~np.isnan(a)).sum())


@pytest.mark.parametrize("connectivity", [4, 8])
def test_labels(spark, connectivity):
    m = np.random.default_rng(5).random((14, 15)) < 0.4
    got = grid(network.label_components(cells(spark, m.astype(float)).withColumnRenamed("z", "skel"), "skel", connectivity), "label").astype(int)
    want, n = np.zeros(m.shape, int), 0
    for y, x in np.argwhere(m):
        if not want[y, x]:
            n += 1
            todo = [(y, x)]
            while todo:
                v, w = todo.pop()
                if 0 <= v < 14 and 0 <= w < 15 and m[v, w] and not want[v, w]:
                    want[v, w] = n
                    todo += [(v + a, w + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if connectivity == 8 or abs(a) + abs(b) == 1]
    assert (got == want).all()


def test_march_is_distance_for_constant_speed():
    t = network.march(np.full((41, 41), 2.0), np.ones((41, 41), bool), (20, 20))
    y, x = np.indices(t.shape)
    r = np.hypot(y - 20, x - 20)
    far = r > 5
    assert np.abs(t[far] * 2 / r[far] - 1).max() < 0.13
    assert t[20, 21] == pytest.approx(0.25)
    wall = np.ones((5, 5), bool)
    wall[:, 2] = False
    assert np.isinf(network.march(np.ones((5, 5)), wall, (2, 0))[2, 4])


def test_descent_uses_the_least_neighbour_as_the_next_level():
    geo = np.array([[0.5, 1, 2], [1, 2, 3], [2, 3, 4.0]])
    assert network.descend(geo, (2, 2)) == [(2, 2), (1, 1), (0, 0)]
    geo[0, 1] = np.nan
    assert network.descend(geo, (2, 2)) == [(2, 2), (1, 1)]
    assert len(network.descend(np.ones((4, 4)), (1, 1))) <= 16


def test_reaches_split_where_visits_change():
    a = [(0, y, 5, 1 if y > 3 else 2) for y in range(8, -1, -1)]
    b = [(1, y, 9 - y + 1 if y > 3 else 5, 1 if y > 3 else 2) for y in range(8, -1, -1)]
    got, junctions = network.split_reaches(a + b)
    assert junctions == [(3, 5)]
    assert [sum(r[0] == k for r in got) for k in (1, 2, 3)] == [6, 4, 6]


@pytest.mark.parametrize("values, top, low", [
    ([1, 3, 2, 5, 4], [3, 1], [0, 2, 4]), ([1, 2, 3], [2], [0]), ([3, 2, 1], [0], [2]), ([2, 2, 2], [0], [0]), ([1, 4, 4, 4, 0], [2], [4, 0]),
    ([float("nan"), 1, float("nan"), 5, 0], [3], [4, 1]), ([], [], [])])
def test_extrema(values, top, low):
    got = local_extrema(values)
    assert got[1] == top and got[3] == low


@pytest.mark.parametrize("double", [False, True])
def test_tiff_round_trip(spark, tmp_path, double):
    a = np.random.default_rng(2).normal(size=(37, 23)).astype("f8" if double else "f4")
    a[3, 4] = np.nan
    r = geotiff.Raster(a, (10.0, 2.0, 0.0, 20.0, 0.0, -2.0), "name|", -9999.0, (1, 1, 0, 0))
    got = geotiff.decode(geotiff.encode(r, double))
    np.testing.assert_array_equal(got.values, a)
    assert (got.gt, got.projection, got.nodata, got.geo_keys) == (r.gt, r.projection, r.nodata, r.geo_keys)
    geotiff.write(cells(spark, a, "one").unionByName(cells(spark, a + 1, "two")), str(tmp_path))
    back = geotiff.read_cells(spark, f"{tmp_path}/*.tif").persist()
    assert back.count() == 2 * a.size and geotiff.read_meta(spark, f"{tmp_path}/*.tif").count() == 2
    np.testing.assert_allclose(grid(back.filter("raster_id = 'two'"), "z"), a + 1, rtol=1e-5)


def test_layers_round_trip_and_prune(spark, tmp_path):
    tables.write_layers(rasters.formed(spark, "val"), f"{tmp_path}/l", rows=32)
    back = tables.read_layers(spark, f"{tmp_path}/l")
    assert back.count() == rasters.NY * rasters.NX
    plan = back.filter("raster_id = 'val' and strip = 1")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(raster_id" in plan


def test_large_quantile(spark):
    x = rasters.formed(spark, "y")
    want = stats.quantiles(x, "z", [0.9], "m").first()["q"]
    assert stats.large_quantile(x, "z", 0.9, "m", most=100) == pytest.approx(want)


def test_network_of_two_tributaries(spark):
    n = pipeline.extract(rasters.formed(spark, "y"), TerrainConfig())
    assert n.starts.count() == 1 and n.heads.count() >= 1
    reach = n.reaches.filter("kind = 'reach'")
    path = n.paths.select("y", "x").distinct()
    assert path.join(reach, ["y", "x"], "left_anti").count() == 0
    assert n.layers.filter("basin = 0").count() == 0
    assert {r["code"] for r in n.section_map.select("code").distinct().collect()} <= {0, 1, 2, 3, 999}


def test_generations():
    assert generation("v0").connectivity == 4 and generation("v3") == TerrainConfig()
    with pytest.raises(ValueError):
        generation("v9")


def test_shared_folder_has_no_default_on_a_cluster():
    class Session:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            get = staticmethod(lambda key, default: default)

    from rillflow.operators.graph import shared_dir

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session)
