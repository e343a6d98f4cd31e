"""Every registered query against DuckDB at the smallest scale."""

from __future__ import annotations

import pytest
from compare import connection, difference

from skarn import workload

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_query_equals_oracle(spark, duck, name):
    found = workload.QUERIES[name](spark, SF)
    if name in workload.ORACLE_SQL:
        assert difference(found, duck.execute(workload.ORACLE_SQL[name]).df()) is None
    else:
        assert found.count() > 0


def test_windows_on_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    counted = workload.windowed_counts(stream, "ts", "event_type")
    query = counted.writeStream.outputMode("update").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    want = {tuple(r) for r in workload.windowed_counts(events, "ts", "event_type").collect()}
    assert {tuple(r) for r in spark.table("windows").collect()} == want


@pytest.mark.parametrize("name,sort", [("topk", "TakeOrderedAndProject"), ("scan_range", "PushedFilters: [IsNotNull(o_orderkey), GreaterThanOrEqual(o_orderkey,100), LessThan(o_orderkey,2000)]")])
def test_plans(spark, name, sort):
    plan = workload.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert sort in plan


def test_scans_read_only_what_they_need(spark):
    plan = workload.QUERIES["flagship_revenue"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double>" in plan and "Python" not in plan
