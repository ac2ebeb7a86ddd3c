"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from panelforge.plans import oracle, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(rows):
    def value(v):
        return round(v, 6) if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else v

    return sorted((tuple(value(v) for v in r) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", ["price_panel", "log_returns", "validate_panel", "block_covariances", "orders_block_covariances", "reference_pca", "approximation_summary", "rmse_by_method", "psd_diagnostics", "whittle_grid_minimum", "arfima_forecast", "whittle_fit", "ar_order_selection", "complete_forecasts", "moment_tensor", "monthly_contributions"])
def test_query_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    made = duck.sql(oracle.ORACLES[name])
    assert sorted(made.columns) == columns
    want = made.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    have = plain(got.select(*columns).collect())
    near = plain(want)
    assert len(have) == len(near)
    for a, b in zip(have, near, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == pytest.approx(y, abs=2e-6) if isinstance(x, float) else x == y


def test_registry():
    assert set(oracle.ORACLES) <= set(queries.QUERIES)
    assert set(queries.QUERIES) <= set(entry.queries()) and set(oracle.ORACLES) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def test_all_invariants_hold(spark):
    assert {r["violations"] for r in queries.QUERIES["invariant_violations"](spark, SF).collect()} == {0}


def test_plan_reads_only_what_it_needs(spark):
    plan = queries.QUERIES["log_returns"](spark, SF)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "l_tax" not in plan and "l_orderkey" not in plan
