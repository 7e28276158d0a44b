"""Registered queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from rillflow.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
SOME = ["dem_scan", "multi_raster_stats", "slope_magnitude", "curvature_geometric", "quantile_8", "diffusion_kernel_3iter", "flow_accumulation_d8", "channel_heads", "geodesic_paths", "cross_section_values", "export_lines_wkt",
        "qq_plot", "local_extrema", "reach_segments", "junctions", "bank_points", "section_map", "export_sections_wkt", "export_banks_wkt", "export_points_wkt", "flow_accumulation_mfd", "diffusion_kernel_30iter", "network_layers"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        db.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = QUERIES[name](spark, DATA).toPandas(), db.sql(ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want)
    keys = [c for c in cols if got[c].dtype.kind != "f"]
    got, want = (d[cols].sort_values(keys + [c for c in cols if c not in keys]).reset_index(drop=True) for d in (got, want))
    for c in cols:
        if got[c].dtype.kind == "f":
            np.testing.assert_allclose(got[c], want[c].astype(float), atol=2e-6)
        else:
            assert (got[c] == want[c]).all()


def test_without_the_llm_subpackage(tmp_path):
    """The entry points import and list queries where the subpackage and its pipeline are absent."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/rillflow", f"{tmp_path}/rillflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'dem_scan' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
