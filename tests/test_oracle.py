"""Every query with SQL gives DuckDB's rows; every other one runs."""

import math
import os

import duckdb
import pytest

from marginalia.plans import core_queries, more_queries  # noqa: F401


def plain(v):
    if isinstance(v, float) and not isinstance(v, bool):
        return "NaN" if math.isnan(v) else (f"{v:.7g}" if v else "0")
    return "NULL" if v is None else str(v)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(core_queries.SQL))
def test_same_rows(spark, data, duck, name):
    df = core_queries.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    rel = duck.execute(core_queries.SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    assert {t for _, t in df.dtypes} <= {"bigint", "double", "string", "boolean", "timestamp"}


@pytest.mark.parametrize("name", sorted(set(core_queries.QUERIES) - set(core_queries.SQL)))
def test_runs(spark, data, name):
    df = core_queries.QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns
