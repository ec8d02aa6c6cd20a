"""Every registered query that has an SQL twin gives the same rows on the smallest sample."""

import duckdb
import pytest

from check import TABLES, canonical

from __spark_entry__ import entry
from clausewise.plans.catalog import QUERIES
from clausewise.plans.oracles import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, con, name):
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    got = canonical(df.toPandas())
    want = canonical(con.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    assert len(got) == len(want)
    assert (got == want).all().all()


def test_every_query_has_a_twin_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == {"fuzzy_anchor", "tiered_verify"}


def test_entry(spark):
    assert entry(spark).limit(1).count() == 1
