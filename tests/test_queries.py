"""Every query with an SQL twin against DuckDB on the smallest tables; the others run and give rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from palindra import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    columns = sorted(frame.columns)
    return sorted(tuple("" if x is None or x != x else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, duck, name):
    mine, theirs = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    for c in mine.columns:
        if mine[c].dtype.kind in "iuf" and theirs[c].dtype.kind in "iuf" and mine[c].dtype != theirs[c].dtype:
            mine[c], theirs[c] = mine[c].astype("float64"), theirs[c].astype("float64")
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_kernel_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_recall_is_an_equi_join(spark):
    plan = catalog.QUERIES["mirror_candidates"](spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
