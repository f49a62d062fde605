from collections import defaultdict
from hashlib import sha256
from math import ceil, floor, log2
from zlib import crc32

import pytest
import xxhash

from packetloom.llm import kdtree


def check(df, shards):
    rows = df.collect()
    got = kdtree.shard(df, shards, slot_block=7).collect()
    assert len(got) == len(rows)
    texts = {crc32((r.text or "").encode()): (r.text or "") for r in rows}
    want = sorted(((r.doc_id, len((r.text or "").encode()) + 16, crc32((r.text or "").encode())) for r in rows), key=str)
    assert sorted(((r.doc_id, r.size, r.text_crc32) for r in got), key=str) == want
    where, loads, slots = defaultdict(set), defaultdict(int), defaultdict(list)
    for r in got:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        where[texts[r.text_crc32]].add(r.shard)
        loads[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return loads, rows


def test_sizes_are_near_equal(docs):
    loads, rows = check(docs, 8)
    points = defaultdict(int)
    for r in rows:
        points[r.text or ""] += len((r.text or "").encode()) + 16
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) <= 2 * max(points.values())


def test_odd_rows(odd, none):
    check(odd, 5)
    check(odd, 40)
    assert kdtree.shard(none, 40).count() == 0


def test_a_crowded_coordinate_is_cut_inside(spark):
    df = spark.createDataFrame([(i, f"text number {i:04d}", "en", "one", 16) for i in range(2000)], "doc_id long, text string, lang string, source string, n_chars long")
    loads, _ = check(df, 16)
    assert max(loads.values()) < 1.05 * min(loads.values())


def tree(rows, shards):
    """The shard of each text by a plain recursion over sorted keys, with exact medians."""
    points, names = {}, {c: sorted({r[c] for r in rows if r[c] is not None}) for c in ("source", "lang")}
    for r in rows:
        text = r.text or ""
        p = points.setdefault(text, {"bytes": 0, "length": log2(len(text) + 1.0), "source": [], "lang": []})
        p["bytes"] += len(text.encode()) + 16
        for c in ("source", "lang"):
            p[c].append(-1.0 if r[c] is None else names[c].index(r[c]) + 1.0)
    dims = ("length", "source", "lang")
    for c in ("source", "lang"):
        for p in points.values():
            p[c] = min(p[c])
    keys = {}
    for c in dims:
        lo, hi = min(p[c] for p in points.values()), max(p[c] for p in points.values())
        for text, p in points.items():
            tie = xxhash.xxh64_intdigest(sha256(text.encode()).digest(), 42) >> 26
            keys[text, c] = (int((p[c] - lo) / ((hi - lo) or 1.0) * ((1 << 24) - 1)) << 38) + tie
    out = {}

    def split(texts, first, k):
        if k == 1 or not texts:
            out.update({t: first for t in texts})
            return
        spread = {c: (max(keys[t, c] for t in texts) >> 38) - (min(keys[t, c] for t in texts) >> 38) for c in dims}
        dim = max(dims, key=lambda c: spread[c])
        texts = sorted(texts, key=lambda t: keys[t, dim])
        total, below = sum(points[t]["bytes"] for t in texts), 0
        for t in texts:
            if below + points[t]["bytes"] >= total * (k // 2) / k:
                break
            below += points[t]["bytes"]
        choices = []
        for cut, left in ((keys[t, dim], below), (keys[t, dim] + 1, below + points[t]["bytes"])):
            for n in {max(1, min(k - 1, f(left / total * k))) for f in (floor, ceil)}:
                choices.append((max(left / n, (total - left) / (k - n)), cut, n))
        _, cut, n = min(choices)
        split([t for t in texts if keys[t, dim] < cut], first, n)
        split([t for t in texts if keys[t, dim] >= cut], first + n, k - n)

    split(list(points), 0, shards)
    return out


@pytest.mark.parametrize("shards", [5, 40])
def test_the_tree_is_that_of_plain_recursion(docs, rows, odd, shards):
    for df, own in ((docs, rows), (odd, odd.collect())):
        want = tree(own, shards)
        got = {(r.doc_id, r.text_crc32): r.shard for r in kdtree.shard(df, shards, tolerance=0.0).collect()}
        assert got == {(r.doc_id, crc32((r.text or "").encode())): want[r.text or ""] for r in own}


def test_names_that_begin_alike_are_told_apart(spark):
    names = [f"https://a.long.common.host/{i:03d}" for i in range(50)]
    df = spark.createDataFrame([(n,) for n in [*names, names[0], None]], "source string")
    got = {r.source: r["rank"] for r in kdtree.ranks(df).collect()}
    assert got == {n: i + 1.0 for i, n in enumerate(names)}
