"""A profile's hours come with its series, and busy keys that fit into a row are gathered once."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from packetloom.config import Config
from packetloom.operators import beacon, order, shape
from tests.test_operators import T0, conn


def test_rhythms_are_those_of_plain_counting(spark):
    draw, rows = random.Random(4), []
    for k in range(80):
        hours = [(draw.choice([None, *range(480000, 480000 + draw.choice([3, 30, 200]))]), draw.randrange(1, 40)) for _ in range(draw.choice([1, 2, 20, 90]))]
        rows.append((k, [1.0] * 3, [], [0] * 18, hours, draw.choice([480000, 480020]) * 3600.0, 480020 * 3600.0))
    df = spark.createDataFrame(rows, "k int, iv array<double>, sizes array<double>, counts array<int>, hours array<struct<hour: bigint, n: bigint>>, begin double, win_max double")
    df = df.withColumn("ivs", F.transform("iv", lambda x: F.struct(x.alias("iv"), F.lit(0).alias("_bucket")))).drop("iv")
    for r in shape.shaped(df.select("*", F.col("begin").alias("since"), F.col("hours").alias("at"))).collect():
        day, bins = {}, set()
        for hour, n in r["at"]:
            h = None if hour is None else hour % 24
            day[h] = day.get(h, 0) + n
            if r.win_max > r.since:
                bins.add(23 if hour is None else max(0, min(23, int((hour * 3600 - r.since) / (r.win_max - r.since) * 24))))
        n = list(day.values())
        mean, sd, high = statistics.mean(n), statistics.pstdev(n), sum(x >= max(n) * 0.05 for x in n)
        even = 0.0 if len(n) < 2 or sd >= mean else 1 - sd / mean
        assert r.hist_score == pytest.approx(max(even, high / len(n) if len(n) >= 11 and high >= 2 else 0.0))
        longest = max((length for length in range(25) if any(set(range(b, b + length)) <= bins for b in range(24))), default=0)
        assert (r.bars, r.longest) == (len(bins), longest)


def test_a_profile_deals_its_records_out_once(spark):
    df = spark.createDataFrame([("s0", "a", "b", float(i * 60), 1.0) for i in range(30)], "sensor string, src string, dst string, ts double, orig_bytes double")
    plan = beacon.profile(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and plan.count("RepartitionByExpression") == 0


def busy(spark):
    draw, rows = random.Random(9), []
    for k, size in enumerate((5, 60, 150)):
        at = T0
        for _ in range(size):
            at += draw.choice([60.0, 600.0]) + draw.random()
            rows.append((at, "10.0.0.5", f"203.0.113.{k}", 443, "ssl", float(draw.randint(0, 900)), 1.0, 1.0))
    return conn(spark, rows)


@pytest.mark.parametrize("gathered", [0, 100, 10_000])
def test_exact_by_either_way(spark, gathered):
    df, cfg = busy(spark), Config(series_sample=20)
    said = lambda p: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in p.collect())
    assert said(beacon.exact(beacon.profile(df, cfg=cfg), df, cfg=cfg, gathered=gathered)) == said(beacon.profile(df))


def test_keys_that_fit_are_not_refined(spark, monkeypatch):
    df, cfg = busy(spark), Config(series_sample=20)
    monkeypatch.setattr(order, "at_ranks", lambda *a, **k: pytest.fail("refined"))
    assert beacon.exact(beacon.profile(df, cfg=cfg), df, cfg=cfg).count() == 3
