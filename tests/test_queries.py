"""Every query with an oracle against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tileflow.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    out = []
    for r in frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False):
        out.append(tuple("" if x is None else repr(round(float(x), 9)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r))
    return sorted(out)


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.entry(spark).columns) == {"z", "state", "n"}
    assert set(e.oracle_sql()) <= set(e.queries())


def test_requests_are_not_shuffled_by_routing(spark):
    plan = QUERIES["url_route"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(req_id" not in plan
