"""The contract, and a sample of queries held against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and "difference" in df.columns


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.catalogue.ORACLE_SQL))
def test_matches_duckdb(spark, name):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = db.execute(contract.oracle_sql()[name])
    names = [x[0] for x in found.description]
    df = contract.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    show = lambda v: f"{v:.7g}" if isinstance(v, float) else str(v)
    assert sorted([show(r[c]) for c in names] for r in df.collect()) == sorted([show(v) for v in row] for row in found.fetchall())
