"""Driver contract: every registered query against its DuckDB oracle on the
smallest tables, plus plan checks (no Cartesian product, no Python UDF)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF001, SF01

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return str(v) if not isinstance(v, (int, bool)) else v


def _canon(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert set(df.columns) >= {"sheet", "status", "antecedent", "consequent", "support"}
    df.count()


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 60


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF001)
    rel = duck.execute(entry.oracle_sql()[name])
    dcols = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _canon(df.columns, [tuple(r) for r in df.collect()]) == _canon(dcols, rel.fetchall())


@pytest.mark.parametrize("name", ["T3_cosine_documents", "M6_grid_all_products", "M13_replace_first",
                                  "G10_classify_products", "W2_precision_at_k", "M9_deadstock_grid"])
def test_plan_shape(spark, name):
    df = entry.queries()[name](spark, SF01)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
