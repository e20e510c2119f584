"""Every query with SQL against DuckDB, and the entry module's contract."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from glyphflow.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return c


def rows(df):
    show = lambda v: None if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    df = df[sorted(df.columns)].astype(object)
    return list(df.columns), sorted((tuple(map(show, r)) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE_SQL:
        assert rows(got) == rows(duck.execute(registry.ORACLE_SQL[name]).df())
    assert len(got)


def test_entry(spark):
    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["roi_id", "token_ids", "token_count", "confidence"]
