import duckdb
import pytest

import __spark_entry__ as entry
from lexweave import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(own.QUERIES))
def test_query_equals_sql(spark, small, duck, name):
    got = own.QUERIES[name](spark, small)
    columns = sorted(got.columns)
    rows = sorted(tuple(map(repr, r)) for r in got.select(*columns).collect())
    if name in own.ORACLE:
        expected = duck.sql(own.ORACLE[name])
        assert sorted(expected.columns) == columns
        assert rows == sorted(tuple(map(repr, r)) for r in duck.sql(f"SELECT {', '.join(columns)} FROM ({own.ORACLE[name]})").fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["query", "best_match", "score"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
