"""The driver's contract: every query against its SQL on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = __spark_entry__.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v if v is None or isinstance(v, (int, bool)) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tiny}/{t}.parquet'")
    want = con.sql(SQL[name])
    df = __spark_entry__.queries()[name](spark, tiny)
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    at = [want.columns.index(c) for c in cols]
    assert Counter(tuple(plain(r[c]) for c in cols) for r in df.collect()) == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_names_and_sql_match():
    assert set(SQL) <= set(__spark_entry__.queries())
