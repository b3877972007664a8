"""Every registered query with SQL gives the same rows as DuckDB on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from proofmill import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df):
    cols = sorted(df.columns)

    def cell(v):
        if v is None or str(v) in ("<NA>", "NaT", "nan"):
            return "null"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) or type(v).__name__.startswith(("int", "float")) else str(v)

    return cols, sorted(tuple(map(cell, r)) for r in df[cols].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(registry.ORACLE[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
