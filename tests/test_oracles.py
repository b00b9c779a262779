"""Every query with oracle SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from veriglot.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def rows(df):
    def plain(x):
        if x is None or x != x:
            return None
        return round(float(x), 6) if isinstance(x, float) else x

    columns = sorted(df.columns)
    return columns, sorted((tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS FROM '{SF}/{f}'")
    return db


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    assert list(map(str, rows(QUERIES[name](spark, SF).toPandas()))) == list(map(str, rows(duck.sql(ORACLE_SQL[name]).df())))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
