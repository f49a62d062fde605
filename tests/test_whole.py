"""Keys with very many records are profiled over all of them: queries on such tables against their SQL."""

import duckdb
import pytest

import __spark_entry__
from tests.test_queries import plain

WHOLE = ["det_beacon_profile", "det_beacon_hints", "det_dns_beacon_profile", "stat_profile_lineitem"]


@pytest.fixture(scope="module")
def busy(tmp_path_factory):
    """Events and lineitems of few keys with over 10 000 records, and of many small ones."""
    at = tmp_path_factory.mktemp("busy")
    con = duckdb.connect()
    con.sql("SELECT setseed(0.4)")
    con.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(CAST(sum(gap) OVER (ORDER BY i) * 1e6 AS BIGINT)) AS ts,
      CASE WHEN i % 8 = 0 THEN i % 40 ELSE 41 END AS user_id, CASE WHEN i % 9 < 7 THEN 'signup' ELSE 'click' END AS event_type, round(pow(random(), 3) * 300, 2) AS value,
      concat('{{"k": ', CASE WHEN i % 11 = 0 THEN 22 ELSE 18 END, '}}') AS props
      FROM (SELECT i, CASE WHEN i % 5000 = 0 THEN 40000 ELSE pow(random(), 4) * 90 END AS gap FROM range(18000) r(i) ORDER BY i)) TO '{at}/events.parquet'""")
    con.sql(f"""COPY (SELECT 'N' AS l_returnflag, CASE WHEN i % 11 = 0 THEN i % 30 ELSE 99 END AS l_suppkey, DATE '1992-01-01' + CAST(floor(pow(random(), 2) * 2500) AS INT) AS l_shipdate,
      i % 7 + 1 AS l_linenumber, CAST(pow(random(), 2) * 50 AS DECIMAL(15, 2)) AS l_quantity FROM range(13000) r(i)) TO '{at}/lineitem.parquet'""")
    for t in ("events", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    return str(at), con


@pytest.mark.parametrize("name", WHOLE)
def test_busy_keys_as_sql(spark, busy, name):
    df, want = __spark_entry__.queries()[name](spark, busy[0]), busy[1].sql(__spark_entry__.oracle_sql()[name])
    cols = sorted(df.columns)
    at = [want.columns.index(c) for c in cols]
    said = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=str)
    assert said([r[c] for c in cols] for r in df.collect()) == said([r[i] for i in at] for r in want.fetchall())
