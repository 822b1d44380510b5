"""Every registered query against its SQL at the smallest scale."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, table


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = queries()[name](spark, sf_dir)
    got = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = duck.execute(oracle_sql()[name])
    want = table([d[0] for d in cursor.description], cursor.fetchall())
    assert got == want
    assert got[1], "empty result proves nothing"


def test_entry(spark):
    assert entry(spark).count() > 0


def test_oracle_names_are_queries():
    assert set(oracle_sql()) <= set(queries())
