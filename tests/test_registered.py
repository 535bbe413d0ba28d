"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check import connect, differences
from conftest import SMALL

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    return connect(SMALL)


@pytest.mark.parametrize("name", [name for name in QUERIES if name in SQL])
def test_equals_sql(spark, tables, name):
    assert differences(QUERIES[name](spark, SMALL), tables, SQL[name]) == []


@pytest.mark.parametrize("name", [name for name in QUERIES if name not in SQL])
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_no_sql_without_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.count() == 8
    assert rows.columns == ["id", "rule", "ts", "first_ts", "first_seq"]


COUNTS = {"small_then_large": 8, "small_then_large_all_types": 5, "insider_exfil": 4,
          "insider_exfil_all_types": 2, "followed_by": 8}


@pytest.mark.parametrize("name", COUNTS)
def test_known_counts(spark, name):
    assert QUERIES[name](spark, SMALL).count() == COUNTS[name]


@pytest.mark.parametrize("name", ["report_dashboard_last_hour", "report_daily_7d", "report_executive_30d", "report_current_hour",
                                  "report_risk_trend_7d", "report_top_patterns", "report_fraud_vs_insider"])
def test_reports_scan_their_period(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
    scans = [line for line in plan[plan.index("== Physical Plan =="):].splitlines() if "FileScan" in line]
    assert scans and all("GreaterThanOrEqual(ts" in line for line in scans)


def test_streams_have_the_sql_of_their_batch_twins():
    streams = [name for name in QUERIES if name.endswith("_stream") and name.removesuffix("_stream") in QUERIES]
    assert len(streams) >= 11 and all(SQL[name] == SQL[name.removesuffix("_stream")] for name in streams)
