"""The audit against plain counting over all orders, document by document."""

import re
from collections import defaultdict
from itertools import permutations

import duckdb
import numpy as np
import pytest

from packetloom.llm import audit, queries
from tests.llm.conftest import SF

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(rows, labels) -> dict:
    said = defaultdict(lambda: [0, 0])
    for r in labels:
        said[r.doc_id] = [max(said[r.doc_id][0], int(r.quality == 1)), max(said[r.doc_id][1], int(r.toxic == 1))]
    said.pop(None, None)
    least: dict[str, int] = {}
    for r in rows:
        if r.doc_id is not None:
            least[r.text or ""] = min(least.get(r.text or "", r.doc_id), r.doc_id)
    docs = []
    for r in rows:
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": r.doc_id is not None and least[t] < r.doc_id,
        }
        docs.append((r.source or "", {k for k, v in fails.items() if v}, *(said[r.doc_id] if r.doc_id in said else (0, 0))))
    out: dict = defaultdict(lambda: [0] * 7)
    for order in map("".join, permutations("ABCDE")):
        for part, fails, good, toxic in docs:
            gone = False
            for step, f in enumerate(order, 1):
                row = out[part, order, step]
                if f in fails:
                    row[2 if gone else 1] += 1
                    row[3] += fails == {f}
                    if not gone:
                        row[4] += good
                        row[5] += toxic
                        gone = True
                elif not gone:
                    row[0] += 1
    total: dict = defaultdict(int)
    for (part, order, step), row in out.items():
        total[part, order[step - 1]] += row[1]
    for (part, order, step), row in out.items():
        row[6] = total[part, order[step - 1]]
    return dict(out)


def got(df) -> dict:
    return {(r.part, r.filter_order, r.step): [r[c] for c in COUNTS] for r in df.collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_table(docs, rows, labels):
    assert got(audit.audit(docs, labels)) == brute(rows, labels.collect())


def test_sketch_dealt_to_slices_and_hashes_of_several_texts(docs, rows, labels, monkeypatch):
    want = brute(rows, labels.collect())
    assert got(audit.audit(docs, labels, sketch_bytes=0)) == want
    assert got(audit.audit(docs, labels, bits=5)) == want
    assert got(audit.audit(docs, labels, bits=5, sketch_bytes=0)) == want


def test_odd_rows_and_nothing(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1), (4, 0, None), (None, 1, 1), (6, 0, 1), (6, 0, 1)], "doc_id long, quality int, toxic int")
    assert got(audit.audit(odd, labels)) == brute(odd.collect(), labels.collect())
    assert got(audit.audit(odd, labels, bits=1)) == brute(odd.collect(), labels.collect())
    assert audit.audit(none, labels).count() == 0 and got(audit.audit(odd, labels.limit(0))) == brute(odd.collect(), [])


def test_sketch_clears_unique_texts_only(spark, docs):
    rows = audit.flags(audit.read(docs)).select("h")
    seen = defaultdict(int)
    for r in rows.collect():
        seen[r.h] += 1
    for limit in (audit.SKETCH_BYTES, 0):
        possible = [r.h for r in audit.possible_repeats(rows, limit).collect()]
        assert len(possible) == len(set(possible)) and {h for h, n in seen.items() if n > 1} <= set(possible)
        assert len(possible) < 0.2 * len(seen)


def test_partial_sketches_add_up():
    h = np.random.default_rng(5).integers(-(1 << 63), 1 << 63, 4000)
    one, both = audit.Slice(), (audit.Slice(), audit.Slice())
    which, at = audit.places(h, 1)
    assert not which.any() and at.max() < audit.SLICE
    for k, own in enumerate((at[:2500], at[2000:])):
        place, n = np.unique(own, return_counts=True)
        both[k].merge(place[n == 1].astype("<u4").tobytes(), place[n > 1].astype("<u4").tobytes())
        one.merge(place[n == 1].astype("<u4").tobytes(), place[n > 1].astype("<u4").tobytes())
    assert (one.seen == both[0].seen | both[1].seen).all()
    assert (one.again == both[0].again | both[1].again | both[0].seen & both[1].seen).all()
    assert one.possible(at[2000:2500]).all() and audit.Slice(one.planes()).possible(at[2000:2500]).all()


def test_sql_says_the_same(spark, docs, rows, labels):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    said = con.sql(queries.ORACLE_SQL["op12_filter_audit"])
    at = said.columns
    assert {(r[at.index("part")], r[at.index("filter_order")], r[at.index("step")]): [r[at.index(c)] for c in COUNTS] for r in said.fetchall()} == brute(rows, labels.collect())
