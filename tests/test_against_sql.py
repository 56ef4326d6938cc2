"""Every check query with an SQL twin gives the same rows on the smallest tables."""

import math
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return "~"
    if isinstance(v, (float, Decimal)) and not isinstance(v, bool):
        return "nan" if math.isnan(v) else repr(round(float(v), 6) + 0.0)
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_same_rows(spark, duck, name):
    df = entry_points.queries()[name](spark, SF)
    mine = _rows(df.columns, df.collect())
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert mine
        return
    result = duck.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    assert mine == _rows(names, result.fetchall())


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() > 0
