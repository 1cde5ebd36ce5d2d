"""Every registered query against its SQL twin in DuckDB."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as se
from wardgate.plans.registry import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
TABLES = ("orders", "customer", "part", "documents")

# No Python in a plan, and no join without a key.
NOT_IN_A_PLAN = (
    "BatchEvalPython",
    "ArrowEvalPython",
    "MapInPandas",
    "CartesianProduct",
    "BroadcastNestedLoopJoin",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> list[tuple]:
    rows = df[sorted(df.columns)].astype(object)
    texts = rows.map(lambda x: "<null>" if pd.isna(x) else str(x))
    return sorted(map(tuple, texts.values.tolist()))


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(se.queries())


def test_entry(spark):
    assert se.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_twin(spark, duck, name):
    query = QUERIES[name](spark, SF_DIR)
    plan = query._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in NOT_IN_A_PLAN if x in plan]
    got = query.toPandas()
    want = duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)
