"""The period search over all timestamps, by either way, against plain sums."""

import math
import random

import pytest

from packetloom.config import Config
from packetloom.operators import beacon, spectrum
from tests.test_operators import T0, conn


def plain(times, grid=2000):
    t0, n, window = min(times), len(times), max(times) - min(times)
    best = None
    for i in range(grid):
        p = 5.0 * (window / 10.0) ** (i / (grid - 1))
        x = math.pi * window / p
        c = sum(math.cos(2 * math.pi * (t - t0) / p) for t in times) - n * math.sin(x) / x * math.cos(x)
        s = sum(math.sin(2 * math.pi * (t - t0) / p) for t in times) - n * math.sin(x) / x * math.sin(x)
        if p <= window / 3 and (best is None or (c * c + s * s) / n > best[1]):
            best = p, (c * c + s * s) / n
    return best


@pytest.mark.parametrize("gathered", [7, 10_000])
def test_periods_are_those_of_plain_sums(spark, gathered):
    draw, made = random.Random(3), {}
    made["a"] = [T0 + i * 300 + draw.uniform(0, 80) for i in range(150) if draw.random() < 0.5]
    made["b"] = [T0 + draw.uniform(0, 9000) for _ in range(60)] + [T0 + 4000.0] * 20
    made["few"], made["short"] = [T0 + 60.0 * i for i in range(15)], [T0 + i / 10 for i in range(40)]
    df = spark.createDataFrame([(k, t) for k, ts in made.items() for t in ts] + [("a", None)], "k string, ts double")
    got = {r.k: r for r in spectrum.periodicity(df, ["k"], gathered=gathered).collect()}
    assert got.keys() == {"a", "b"}
    for k in got:
        period, power = plain(made[k])
        gaps = sorted(b - a for a, b in zip(sorted(made[k]), sorted(made[k])[1:]) if b > a)
        assert got[k].n == len(made[k]) and got[k].median_iv == pytest.approx((gaps[(len(gaps) - 1) // 2] + gaps[len(gaps) // 2]) / 2)
        assert period < got[k].median_iv / 5 or (got[k].period, got[k].power) == (pytest.approx(period), pytest.approx(power))


def test_hints_are_over_all_timestamps(spark):
    draw, at, rows = random.Random(4), T0, []
    for i in range(3200):  # a rhythm that the last 2000 records don't have
        at = T0 + i // 20 * 600 + draw.uniform(0, 200) if i < 1200 else at + draw.expovariate(1 / 7)
        rows.append((at, "10.0.0.5", "203.0.113.9", 443, "ssl", 1.0, 1.0, 1.0))
    df = conn(spark, rows)
    weak = spark.createDataFrame([("s0", "10.0.0.5", "203.0.113.9", 3200, 0.1)], "sensor string, src string, dst string, n long, ts_score double")
    r = beacon.annotated(weak, df, cfg=Config()).first()
    assert r.spectral_rescued and abs(r.spectral_period - 600) < 6
