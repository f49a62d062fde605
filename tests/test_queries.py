"""Registered queries against their SQL on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FAST = [n for n in __spark_entry__.oracle_sql() if not n.startswith(("op", "pipeline"))]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", FAST)
def test_query_as_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    want = duck.sql(__spark_entry__.oracle_sql()[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_periodicity_and_channels_take_the_whole_job(spark, monkeypatch):
    from packetloom.plans import queries as q

    class Any:
        def select(self, *columns):
            return self

    grids, ja3 = [], []
    monkeypatch.setattr(q.stats, "periodicity", lambda df, keys, **more: grids.append(more.get("grid", 2000)) or Any())
    monkeypatch.setattr(q.beacon, "channels", lambda conn, ssl, *more: ja3.append(ssl) or Any())
    __spark_entry__.queries()["stat_periodicity"](spark, SF)
    __spark_entry__.queries()["det_beacon_channels"](spark, SF)
    assert grids == [2000] and ja3[0].selectExpr("max(length(ja3))").first()[0] > 1
