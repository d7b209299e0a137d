"""Every catalog query against its SQL twin on a small scale factor."""

import glob
import math
import os

import duckdb
import pytest

from vitalgrain.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v) if not hasattr(v, "as_tuple") else f"{float(v):.6g}"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(x) for x in r) for r in df.select(*columns).collect())
    found = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert sorted(tuple(plain(r[i]) for i in order) for r in found.fetchall()) == got


def test_pushdown_and_no_python(spark):
    for name in ("tool03_conditions_by_name", "agg06_financial_by_patient", "tool02_timeline", "stub26_patient_claims", "win01_keep_first"):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name
    plan = catalog.queries()["src13_scan_filter_project"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and "GreaterThan(l_quantity" in plan and "l_comment" not in plan
