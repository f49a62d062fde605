"""Exact order statistics of keys of any size (STAT-2, 3, 13), by histograms that are refined where the ranks lie.

No key's values are sorted or gathered: each round counts the values of a key between two bounds in buckets,
with the least and largest value of each bucket, and narrows the bounds to the bucket that holds the wanted
rank. Counts are combined in every task before they are shuffled. A bucket is finished when its values are all
equal, or few enough to be sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators import stats
from packetloom.sources.scratch import written

#: Buckets of a round, and values that are sorted instead.
BUCKETS, FEW = 1024, 4096


def at_ranks(rows: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame, buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """(keys, slot, value): the values at the given ranks (keys, slot, rank), from 0 in ascending order, of each key's values that aren't null.

    Every round is one aggregate over the rows of the keys that are still open; their number is bounded by the bits of
    a double over those of a bucket's number, and is two or three for most data. A rank that a key doesn't have has no row.
    """
    keys = list(keys)
    rows = rows.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    whole = rows.groupBy(*keys).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
    state = ranks.join(whole, keys).filter("rank >= 0 AND rank < _n").select(*keys, "slot", "rank", "_lo", "_hi", "_n")
    state = written(state, "ranks")
    found = state.filter("_lo = _hi").select(*keys, "slot", F.col("_lo").alias("value"))
    while True:
        small = state.filter(f"_lo < _hi AND _n <= {few}")
        # Slots that share their bounds share a list.
        spans = small.select(*keys, "_lo", "_hi").distinct()
        listed = rows.join(spans, keys).filter("_v BETWEEN _lo AND _hi").groupBy(*keys, "_lo", "_hi").agg(F.sort_array(F.collect_list("_v")).alias("_vs"))
        listed = small.join(listed, [*keys, "_lo", "_hi"])
        found = found.union(written(listed.select(*keys, "slot", F.get("_vs", F.col("rank").cast("int")).alias("value")), "values"))
        large = state.filter(f"_lo < _hi AND _n > {few}")
        if large.isEmpty():
            return found
        # Slots that share their bounds share a histogram.
        spans = large.select(*keys, "_lo", "_hi").distinct()
        bucket = F.least(F.lit(buckets - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * buckets))
        held = rows.join(spans, keys).filter("_v BETWEEN _lo AND _hi").groupBy(*keys, "_lo", "_hi", bucket.alias("_b"))
        held = held.agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        before = Window.partitionBy(*keys, "_lo", "_hi").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        held = held.withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        # A key has as many buckets at most as a round has, so this join meets few rows.
        state = large.join(held, [*keys, "_lo", "_hi"]).filter("rank >= _before AND rank < _before + _c")
        state = state.select(*keys, "slot", (F.col("rank") - F.col("_before")).alias("rank"), F.col("_least").alias("_lo"), F.col("_most").alias("_hi"), F.col("_c").alias("_n"))
        state = written(state, "ranks")
        found = found.union(state.filter("_lo = _hi").select(*keys, "slot", F.col("_lo").alias("value")))


def _wanted(sizes: DataFrame, keys: Sequence[str], **at: tuple[Column, Column]) -> DataFrame:
    """Two ranks for each name; their mean is the statistic."""
    slots = [F.struct(F.lit(name).alias("slot"), r.cast("long").alias("rank")) for name, pair in at.items() for r in pair]
    return sizes.select(*keys, F.inline(F.array(*slots))).distinct()


def _means(values: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per key with the mean of each name's values; a pair of equal ranks is one value."""
    return values.groupBy(*keys).agg(*(F.avg(F.when(F.col("slot") == n, F.col("value"))).alias(n) for n in names))


def _middle(n: Column, shift: Column | int = 0) -> tuple[Column, Column]:
    return F.floor((n - 1) / 2) + shift, F.floor(n / 2) + shift


def spread(rows: DataFrame, keys: Sequence[str], value: str, buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """(keys, n, q1, q2, q3, off): size, quartiles as medians of the halves without the middle, and the median distance from the median."""
    keys = list(keys)
    rows = rows.filter(F.col(value).isNotNull())
    sizes = written(rows.groupBy(*keys).agg(F.count("*").alias("n")), "sizes")
    n, half = F.col("n"), F.floor(F.col("n") / 2)
    ranks = _wanted(sizes, keys, q1=_middle(half), q2=_middle(n), q3=_middle(half, n - half))
    quartiles = _means(at_ranks(rows, keys, value, ranks, buckets, few), keys, ("q1", "q2", "q3"))
    held = written(sizes.join(quartiles, keys), "quartiles")
    distances = rows.join(held.select(*keys, "q2"), keys).withColumn("_d", F.abs(F.col(value) - F.col("q2")))
    off = _means(at_ranks(distances, keys, "_d", _wanted(sizes, keys, off=_middle(n)), buckets, few), keys, ("off",))
    return held.join(off, keys)


def median(rows: DataFrame, keys: Sequence[str], value: str, buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """(keys, median) of the values that aren't null."""
    keys = list(keys)
    sizes = rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))
    return _means(at_ranks(rows, keys, value, _wanted(sizes, keys, median=_middle(F.col("n"))), buckets, few), keys, ("median",))


def mad_score(default: float) -> Column:
    """``stats.mad`` from the columns of ``spread``."""
    near = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("q2") - F.col("off")) / F.col("q2")))
    return F.when(F.col("q2") == 0, F.lit(default)).otherwise(near)


def regularity(default: float) -> Column:
    """``stats.regularity`` from the columns of ``spread``."""
    q1, q2, q3 = (F.col(c) for c in ("q1", "q2", "q3"))
    flat = (F.col("n") < 3) | (q3 - q1 < 0.05 * q2) | (q2 == q1) | (q2 == q3)
    skew = F.when(flat, 1.0).otherwise(1.0 - F.abs((q1 + q3 - 2 * q2) / (q3 - q1)))
    return F.round((skew + mad_score(default)) / 2, 3)


def modes(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, _bucket, _mode): the logarithmic buckets that are peaks; neighbouring peaks are one mode. Keys with fewer than six values have none."""
    keys = list(keys)
    rows = rows.filter(F.col(value).isNotNull()).withColumn("_bucket", stats._bucket(F.col(value)))
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_c"))
    of_key = Window.partitionBy(*keys)  # 18 rows of a key at most
    total, most = F.sum("_c").over(of_key), F.max("_c").over(of_key)
    peaks = counts.withColumns({"_total": total, "_most": most}).filter("_total >= 6 AND _c >= _most * 0.5")
    # The numbers of neighbouring peaks rise together with their places.
    return written(peaks.withColumn("_mode", F.col("_bucket") - F.row_number().over(Window.partitionBy(*keys).orderBy("_bucket"))).select(*keys, "_bucket", "_mode"), "modes")


def tight(mode: Column) -> Column:
    """``stats.multimodal`` from the rows of ``spread`` that are modes of a key."""
    n, score = F.when(mode, F.col("n")), F.when(mode, mad_score(0.0))
    good = F.count(n).between(2, 4) & F.bool_and((n >= 2) & (score >= 0.5))
    return F.when(good, F.sum(score * n) / F.sum(n)).otherwise(0.0)


def multimodal(rows: DataFrame, keys: Sequence[str], value: str, buckets: int = BUCKETS, few: int = FEW) -> DataFrame:
    """(keys, multimodal): ``stats.multimodal`` over all values: the tightness of each mode is exact as well.

    Modes come from the counts of a key's logarithmic buckets, 18 at most; then the mode is one more key.
    """
    keys = list(keys)
    rows = rows.filter(F.col(value).isNotNull()).withColumn("_bucket", stats._bucket(F.col(value)))
    inside = rows.join(modes(rows, keys, value), [*keys, "_bucket"])
    each = spread(inside, [*keys, "_mode"], value, buckets, few).groupBy(*keys).agg(tight(F.lit(True)).alias("multimodal"))
    return rows.select(*keys).distinct().join(each, keys, "left").fillna({"multimodal": 0.0})
