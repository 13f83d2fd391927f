"""Every query that has SQL against DuckDB on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from screenlake.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    rel = duck.sql(catalogue.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    want = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    key = lambda r: repr([plain(r[c]) for c in columns])
    assert sorted(map(key, (r.asDict() for r in got.collect()))) == sorted(map(key, want))


def test_entry_and_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    for name in ("bootstrap_intervals", "title_similarity", "ingest_fold"):
        assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_imports_without_a_session():
    """No column is made before there is a session."""
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=Path(__file__).parent.parent, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0 and int(said.stdout.split()[-1]) > 100, said.stderr
