"""Queries of the training-data operators with SQL give DuckDB's rows."""

import duckdb
import pytest

from marginalia.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, data, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW retrieval_results AS SELECT * FROM '{data}/retrieval_results.parquet'")
    df = queries.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    rel = con.execute(queries.SQL[name])
    at = [[d[0] for d in rel.description].index(c) for c in cols]
    want = sorted(tuple(r[i] for i in at) for r in rel.fetchall())
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == want and want
