"""Queries against their SQL on the smallest tables."""

import math
import os

import pytest

from haatgrid.plans import registry

SF = "/root/testdata/sf0.001"
NAMES = ["p1_found", "p1_grid", "p6_found", "p6_rolling", "p7_found", "d2_staged", "d6_rolling_median", "d8_flags", "d10_daily_prices", "d23_drop_labels", "q0_duplicates", "q0_scope_gaps", "q3_gap_by_commodity", "q3_volatility", "sv_latest", "sv_recent", "ml_features", "q3_district_access", "q3_seasonality", "q3_concentration", "q4_cluster_features", "ck_all", "src_describe"]


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.5g}"
    return v.isoformat()[:10] if hasattr(v, "isoformat") else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    got = registry.queries()[name](spark, SF)
    want = c.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    a = sorted(tuple(_norm(v) for v in r) for r in got.select(cols).collect())
    b = sorted(tuple(_norm(v) for v in r) for r in want.fetchall())
    assert a == b
