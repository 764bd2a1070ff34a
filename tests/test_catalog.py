"""Every query with SQL agrees with DuckDB on the smallest tables."""

import re

import duckdb
import pyarrow as pa
import pytest

from sparkloom.operators import frames, keyed
from sparkloom.plans import catalog
from sparkloom.plans.compare import differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    assert not differences(catalog.QUERIES[name](spark, SF).toArrow(), duck.execute(catalog.ORACLES[name]).to_arrow_table())


@pytest.mark.parametrize("name", ["tumbling_window", "stream_sliding", "stream_tumbling"])
def test_the_last_half_millisecond_counts_to_the_next_window(spark, tmp_path, name):
    con = duckdb.connect()
    times = ["2024-01-01 00:59:59.999499", "2024-01-01 00:59:59.999500", "2024-01-01 01:29:59.999800", "2024-01-01 02:00:00"]
    rows = ", ".join(f"({i}::BIGINT, TIMESTAMP '{t}', 7::BIGINT, 'click', 1.5::DOUBLE)" for i, t in enumerate(times))
    con.execute(f"CREATE TABLE events AS SELECT * FROM (VALUES {rows}) v(event_id, ts, user_id, event_type, value)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    assert not differences(catalog.QUERIES[name](spark, str(tmp_path)).toArrow(), con.execute(catalog.ORACLES[name]).to_arrow_table())


def test_no_key_carries_a_sketch_of_distinct_counts(spark):
    plan = catalog.QUERIES["approx_distinct"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "approx_count_distinct" in plan and not re.search(r"keys=\[l_partkey[^\]]*\], functions=\[[^\]]*approx_count_distinct", plan)


def test_differences_are_seen():
    t = lambda **c: pa.table(c)
    assert not differences(t(x=[1, 2], y=["a", None]), t(y=[None, "a"], x=[2, 1]))
    assert differences(t(x=[1704067200000]), t(x=[1704067200001]))  # a millisecond
    assert differences(t(x=[1]), t(x=[1.0])) and differences(t(x=[1, 1]), t(x=[1])) and differences(t(x=[1]), t(z=[1]))
    assert differences(t(x=[0.123456789]), t(x=[0.123456799])) and not differences(t(x=[0.1 + 0.2]), t(x=[0.3]))


def test_multiplicity(spark):
    x, y, z = (spark.createDataFrame([(v,) for v in vs], "k int") for vs in ([1, 1, 2], [1, 3], [1]))
    assert frames.intersect_all(x, y).count() == 1 and frames.intersect_all(x, y, ansi=False).count() == 2
    assert frames.except_all(x, z).count() == 2 and frames.except_all(x, z, ansi=False).count() == 1


def test_corr_is_none_without_variance(spark):
    assert frames.corr(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), "a", "b") is None


def test_histogram_without_bounds(spark):
    assert keyed.histogram(spark.range(3), "id", [1]).count() == 0
