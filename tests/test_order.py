"""Exact order statistics against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from packetloom.config import Config
from packetloom.operators import beacon, order, stats
from tests.test_operators import T0, conn


def drawn(seed, n):
    draw = random.Random(seed)
    kinds = [lambda: 60.0, lambda: draw.gauss(0, 1e-6), lambda: draw.lognormvariate(3, 2), lambda: float(draw.randint(0, 3)), lambda: draw.choice([1e300, -1e300, 5e-324, 0.0])]
    return [kinds[seed % 5]() if draw.random() < 0.9 else draw.uniform(-5, 5) for _ in range(n)]


def test_values_at_ranks(spark):
    data = {f"k{i}": drawn(i, 700 + i) for i in range(10)}
    rows = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("k0", None), ("none", None)], "k string, v double")
    ranks = spark.createDataFrame([(k, f"r{r}", r) for k in [*data, "none"] for r in (0, 1, 350, 699, 5000, -1)], "k string, slot string, rank long")
    got = {(r.k, r.slot): r.value for r in order.at_ranks(rows, ["k"], "v", ranks, buckets=8, few=20).collect()}
    assert got == {(k, f"r{r}"): sorted(vs)[r] for k, vs in data.items() for r in (0, 1, 350, 699)}


def test_scores_are_those_of_sorted_lists(spark):
    draw = random.Random(5)
    made = {"steady": [60 + draw.random() for _ in range(400)], "modes": [draw.choice([60, 600, 6000]) + draw.random() for _ in range(401)], "wild": [draw.lognormvariate(4, 2) for _ in range(300)], "two": [5.0, 7.0], "one": [3.0], "even": [1.0] * 50}
    rows = spark.createDataFrame([(k, v) for k, vs in made.items() for v in vs], "k string, v double")
    xs = F.array_sort(F.collect_list("v"))
    want = {r.k: (r.m, r.r, round(r.mm, 9)) for r in rows.groupBy("k").agg(xs.alias("x")).select("k", stats.median(F.col("x")).alias("m"), stats.regularity(F.col("x"), 1.0).alias("r"), stats.multimodal(F.col("x")).alias("mm")).collect()}
    one = order.spread(rows, ["k"], "v", 16, 30).select("k", F.col("q2").alias("m"), order.regularity(1.0).alias("r"))
    both = one.join(order.multimodal(rows, ["k"], "v", 16, 30), "k")
    assert {r.k: (r.m, r.r, round(r.multimodal, 9)) for r in both.collect()} == want and want["modes"][2] > 0.5


@pytest.mark.parametrize("sample", [20, 10**9])
def test_busy_keys_are_profiled_over_all_records(spark, sample):
    draw, rows = random.Random(8), []
    for k in range(3):
        at = T0
        for _ in range(120):
            at += draw.choice([60.0, 600.0]) + draw.random() * (k + 1)
            rows.append((at, "10.0.0.5", f"203.0.113.{k}", 443, "ssl", float(draw.randint(0, 900)), 1.0, 1.0))
    df = conn(spark, rows)
    said = lambda p: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in p.collect())
    cfg = Config(series_sample=sample)
    assert said(beacon.exact(beacon.profile(df, cfg=cfg), df, cfg=cfg)) == said(beacon.profile(df))
