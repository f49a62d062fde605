"""Figures of many keys at once are those of each by itself, and a profile orders its records once."""

import random

from pyspark.sql import functions as F

from packetloom.operators import beacon, shape, stats
from packetloom.plans.views import VIEWS, view


def test_shapes_are_those_of_the_expressions(spark):
    draw = random.Random(5)
    rows = []
    for k in range(60):
        n, modes = draw.choice([3, 4, 5, 6, 7, 30, 90]), draw.choice([[60.0], [60.0, 600.0], [5.0, 90.0, 4000.0], [2.0**i for i in range(1, 17)]])
        rows.append((k, [draw.choice(modes) * draw.choice([1.0, 1.0, 1.02, 1.3]) for _ in range(n)], [float(draw.randrange(1, 50)) for _ in range(draw.randrange(6))]))
    rows.append((60, [60.0, 60.0, 60.0], []))
    df = spark.createDataFrame(rows, "k int, xs array<double>, sizes array<double>")
    series = df.select("k", F.transform("xs", lambda x: F.struct(x.alias("iv"), stats._bucket(x).alias("_bucket"))).alias("ivs"), "sizes", stats._counts(F.col("xs")).alias("counts"))
    got = {r.k: (r.median_iv, r._raw, r._mm, r._ds) for r in shape.shaped(series).collect()}
    xs, sizes = F.sort_array("xs"), F.sort_array("sizes")
    raw, ds = (stats.bowley(xs) + stats.mad(xs, 1.0)) / 2, F.when(F.size(sizes) >= 3, (stats.bowley(sizes) + stats.mad(sizes, 0.0)) / 2).otherwise(0.0)
    want = {r.k: tuple(r)[1:] for r in df.select("k", stats.median(xs), raw, stats.multimodal(xs), ds).collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in got for a, b in zip(got[k], want[k]))
    assert any(r[2] > 0 for r in got.values()) and any(r[2] == 0 for r in got.values())


def test_a_profile_orders_its_records_once(spark):
    df = spark.createDataFrame([("s0", "a", "b", float(i * 60), 1.0) for i in range(30)], "sensor string, src string, dst string, ts double, orig_bytes double")
    plan = beacon.profile(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [lag(") == 1


def test_a_view_reads_its_field_once(spark):
    assert "{K}" in VIEWS["wide_v"][1]
    plan = view(spark, "/root/testdata/sf0.001", "wide_v").filter("score >= 0")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") <= 3
