"""The queries that have SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from screenlake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(rel.columns)
    want = sorted(map(repr, (tuple(r) for r in rel.select(*got.columns).fetchall())))
    assert sorted(map(repr, map(tuple, got.collect()))) == want
