"""Time-series statistics per key (STAT): one shared sort per key, then one aggregation.

Every function takes the key columns and column names as parameters, so it runs on any table with a
source, a target and a timestamp.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from packetloom.config import DEFAULT, Config
from packetloom.functions.exprs import let
from packetloom.sources.scratch import written

BUCKETS = 18


def intervals(df: DataFrame, keys: Sequence[str], ts: str = "ts", seq: str | None = None) -> DataFrame:
    """Rows with ``iv``, the seconds since the record before (null unless positive).

    In event order by default; with ``seq`` in arrival order against the latest time seen so far.
    """
    if seq is None:
        gap = F.col(ts) - F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts))
    else:
        gap = F.col(ts) - F.max(ts).over(Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("iv", F.when(gap > 0, gap))


def blocked(df: DataFrame, keys: Sequence[str], ts: str = "ts", least: int = 0, block: float = 86400.0) -> DataFrame:
    """Rows of the keys with at least ``least`` records, with ``n``, ``first``, ``last`` of their key and ``iv`` in event order.

    Rows are dealt out by key and block of time, so a busy key lies in many tasks: one small aggregate per
    block gives the key's figures and the latest time before each block.
    """
    keys, own = list(keys), df.withColumn("_block", F.coalesce(F.floor(F.col(ts) / block), F.lit(-(1 << 62))))  # records without a time are a block
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    days = own.groupBy(*keys, "_block").agg(F.count("*").alias("_c"), F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    days = days.select(
        *keys,
        "_block",
        F.max("_hi").over(before).alias("_before"),
        F.sum("_c").over(whole).alias("n"),
        F.min("_lo").over(whole).alias("first"),
        F.max("_hi").over(whole).alias("last"),
    )
    rows = own.join(days.filter(F.col("n") >= least), [*keys, "_block"])
    gap = F.col(ts) - F.coalesce(F.lag(ts).over(Window.partitionBy(*keys, "_block").orderBy(ts)), F.col("_before"))
    return rows.withColumn("iv", F.when(gap > 0, gap)).drop("_block", "_before")


def median(xs: Column) -> Column:
    """Of a sorted array."""

    def of(x: Column) -> Column:
        n = F.size(x)
        middle = F.floor(n / 2).cast("int")
        return F.when(n == 0, F.lit(0.0)).when(n % 2 == 1, F.get(x, middle)).otherwise((F.get(x, middle - 1) + F.get(x, middle)) / 2)

    return let(xs, of)


def bowley(xs: Column) -> Column:
    """1 - |skewness| by quartiles of a sorted array; 1 where it is degenerate."""

    def of(q: Column) -> Column:
        q1, q2, q3 = q["q1"], q["q2"], q["q3"]
        flat = (q["n"] < 3) | (q3 - q1 < 0.05 * q2) | (q2 == q1) | (q2 == q3)
        return F.when(flat, 1.0).otherwise(1.0 - F.abs((q1 + q3 - 2 * q2) / (q3 - q1)))

    def quartiles(x: Column) -> Column:
        n = F.size(x)
        half = F.floor(n / 2).cast("int")
        q1, q3 = median(F.slice(x, F.lit(1), half)), median(F.slice(x, n - half + 1, half))
        return let(F.struct(n.alias("n"), q1.alias("q1"), median(x).alias("q2"), q3.alias("q3")), of)

    return let(xs, quartiles)


def mad(xs: Column, default: float) -> Column:
    def of(x: Column) -> Column:
        return let(median(x), lambda med: let(median(F.array_sort(F.transform(x, lambda v: F.abs(v - med)))), lambda off: score(x, med, off)))

    def score(x: Column, med: Column, off: Column) -> Column:
        return F.when((F.size(x) == 0) | (med == 0), F.lit(default)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (med - off) / med)))

    return let(xs, of)


def regularity(xs: Column, default: float) -> Column:
    return F.round((bowley(xs) + mad(xs, default)) / 2, 3)


def _bucket(x: Column) -> Column:
    """The power-of-two bucket of a positive interval, within the table."""
    return F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.log2(x).cast("int")))


def _counts(xs: Column) -> Column:
    return let(F.transform(xs, _bucket), lambda bs: F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.size(F.filter(bs, lambda x: x == b))))


def multimodal(xs: Column, counts: Column | None = None) -> Column:
    """Two to four tight modes on the logarithmic scale: their mean tightness, weighted by count; else 0.

    Buckets with half the largest count are peaks, and neighbouring peaks are one mode.
    """

    def of(peaks: Column) -> Column:
        at = lambda b: F.coalesce(F.get(peaks, b), F.lit(False))
        starts = F.filter(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: at(b) & ~((b > 0) & at(F.greatest(b - 1, F.lit(0)))))
        ends = F.filter(F.sequence(F.lit(1), F.lit(BUCKETS)), lambda b: at(b - 1) & ~at(b))
        return let(F.zip_with(starts, ends, judged), weighed)

    def judged(start: Column, end: Column) -> Column:
        samples = F.filter(xs, lambda x: (_bucket(x) >= start) & (_bucket(x) < end))
        return let(samples, lambda m: F.struct(F.size(m).alias("n"), mad(m, 0.0).alias("t")))

    def weighed(modes: Column) -> Column:
        good = F.size(modes).between(2, 4) & F.forall(modes, lambda m: (m["n"] >= 2) & (m["t"] >= 0.5))
        weight = F.aggregate(modes, F.lit(0.0), lambda a, m: a + m["t"] * m["n"])
        return F.when(good, weight / F.aggregate(modes, F.lit(0), lambda a, m: a + m["n"])).otherwise(0.0)

    def peaks_of(counts: Column) -> Column:
        return let(F.array_max(counts), lambda most: F.transform(counts, lambda c: (c > 0) & (c >= most * 0.5)))

    return F.when(F.size(xs) >= 6, let(let(_counts(xs) if counts is None else counts, peaks_of), of)).otherwise(0.0)


def concentration(counts: Column, total: Column) -> Column:
    """1 - entropy over the logarithmic buckets of ``total`` intervals, scaled down where the fullest bucket is wide."""

    def of(counts: Column) -> Column:
        n = total.cast("double")
        bits = F.aggregate(counts, F.lit(0.0), lambda a, c: a - F.when(c > 0, c / n * F.log2(c / n)).otherwise(0.0))
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - bits / math.log2(BUCKETS)))
        top = F.array_position(counts, F.array_max(counts)).cast("int") - 1
        return F.when(top >= 8, score * 128.0 / F.pow(F.lit(2.0), top)).otherwise(score)

    return let(counts, of)


def hourly(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """Records per key and absolute hour: what the daily and the persistence score of keys of any size rest on (``shape``)."""
    return df.groupBy(*keys, F.floor(F.col(ts) / 3600).alias("hour")).agg(F.count("*").alias("n"))


def capture_window(df: DataFrame, sensor: str = "sensor", ts: str = "ts") -> DataFrame:
    return df.filter(F.col(ts) > 0).groupBy(sensor).agg(F.min(ts).alias("win_min"), F.max(ts).alias("win_max"))


def begin(cfg: Config = DEFAULT) -> Column:
    """Where the recent window begins, of win_min and win_max."""
    return F.greatest("win_min", F.col("win_max") - cfg.persistence_days * 86400)


def persistence(cfg: Config = DEFAULT, least_bars: int = 6) -> Column:
    """``dur_score``, of first, last, win_min, win_max, bars and longest: coverage of the recent window or the longest run of its bins."""
    since = begin(cfg)
    coverage = F.least(F.lit(1.0), (F.col("last") - F.greatest(F.col("first"), since)) / (F.col("win_max") - since))
    score = F.greatest(coverage, F.least(F.lit(1.0), F.col("longest") / 12.0))
    return F.when(F.coalesce("bars", F.lit(0)) < least_bars, 0.0).otherwise(score)


def confidence(n: Column, least: int, cfg: Config = DEFAULT) -> Column:
    return 0.5 + 0.5 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (n - least) / float(cfg.confidence_ramp)))


def prevalence(df: DataFrame, sensor: str = "sensor", src: str = "src", dst: str = "dst") -> DataFrame:
    """(sensor, dst, dst_srcs, all_srcs, prevalence_mod): common destinations are damped, rare ones lifted."""
    pairs = written(df.select(sensor, dst, src).distinct(), "pairs")  # both counts rest on these
    all_srcs = pairs.groupBy(sensor).agg(F.countDistinct(src).alias("all_srcs"))
    seen = pairs.groupBy(sensor, dst).agg(F.count(src).alias("dst_srcs")).join(all_srcs, sensor)
    share = F.col("dst_srcs") / F.col("all_srcs")
    mod = F.when((F.col("all_srcs") >= 10) & (share >= 0.5), 0.85).when((F.col("all_srcs") >= 50) & (share <= 0.02), 1.15).otherwise(1.0)
    return seen.withColumn("prevalence_mod", mod)


def peaks(grid: int, threshold: float) -> tuple[Callable, Callable, Callable]:
    """The periods of a window, their powers and the choice among these; made here, they reach the tasks by value."""
    steps = np.arange(grid) / (grid - 1)

    def periods(window: float) -> np.ndarray:
        return 5.0 * (window / 10.0) ** steps

    def beyond(c: np.ndarray, s: np.ndarray, n: int, window: float) -> np.ndarray:
        """The power of sums over all periods, less the sums that an even spread over the window has."""
        x = np.pi * window / periods(window)
        flat = n * np.sin(x) / x
        return ((c - flat * np.cos(x)) ** 2 + (s - flat * np.sin(x)) ** 2) / n

    def chosen(n: int, window: float, median: float, power: np.ndarray, near: np.ndarray) -> tuple:
        """The figures of the strongest period; ``near`` are those whose power is known."""
        period = periods(window)
        best = int(power.argmax())
        fits = np.flatnonzero((period >= median / 5) & (period <= window / 3) & near)
        if not len(fits):
            return (n, median, None, None, 0.0, *((period[best], power[best]) if power[best] >= threshold else (None, None)))
        own = int(fits[power[fits].argmax()])
        score = min(1.0, max(0.0, (power[own] - threshold) / threshold))
        stronger = best != own and power[best] >= threshold and power[best] > power[own]
        return (n, median, period[own], power[own], score, *((period[best], power[best]) if stronger else (None, None)))

    return periods, beyond, chosen


def period_schema(keys: Sequence[StructField]) -> StructType:
    figures = ("median_iv", "period", "power", "spectral_score", "dominant_period", "dominant_power")
    return StructType([*keys, StructField("n", LongType()), *(StructField(x, DoubleType()) for x in figures)])


def periodicity(df: DataFrame, keys: Sequence[str], ts: str = "ts", grid: int = 2000, cfg: Config = DEFAULT, last: int | None = 2000, gated: DataFrame | None = None) -> DataFrame:
    """The strongest plausible period of each key (STAT-11): power |sum exp(2 pi i t / p)|^2 / n less what the mere window gives.

    Keys are gated first, by their count and (``gated``) by whatever the caller asks of them, such as a
    weak timing score; each keeps its ``last`` timestamps (WIN-10), or all without it: ``spectrum`` is for keys
    of any size. Plausible are a fifth of the median
    interval and more, up to a third of the window. ``dominant_period`` is a stronger peak outside of
    that. A key is one row then, and its sums over the grid are arrays within an Arrow batch.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(ts).cast("double").alias("_t")).filter("_t IS NOT NULL")
    if gated is not None:
        rows = rows.join(gated.select(*keys).distinct(), keys, "left_semi")
    enough = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= cfg.spectral_min_observations)
    rows = rows.join(enough.select(*keys), keys, "left_semi").withColumn("_s", F.pmod(F.xxhash64("_t"), F.lit(32)))
    if last is None:
        held = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("_t")).alias("_ts"))
    else:
        # The latest of each of 32 shares, then the latest of these: a busy key is dealt out.
        place = F.row_number().over(Window.partitionBy(*keys, "_s").orderBy(F.desc("_t")))
        latest = F.sort_array(F.slice(F.sort_array(F.collect_list("_t"), False), 1, last))
        held = rows.withColumn("_r", place).filter(F.col("_r") <= last).groupBy(*keys).agg(latest.alias("_ts"))
    schema = period_schema([held.schema[k] for k in keys])
    names, (periods, _, chosen) = schema.names, peaks(grid, cfg.spectral_threshold)

    def strongest(t: np.ndarray) -> tuple | None:
        t, window, n = t - t[0], t[-1] - t[0], len(t)
        gaps = np.diff(t)
        gaps = gaps[gaps > 0]
        if window / 2 < 5.0 or not len(gaps):
            return None
        median, period = float(np.median(gaps)), periods(window)
        omega = 2 * np.pi / period
        x = omega * window / 2
        flat = n * np.sin(x) / x  # an even spread over the window has these sums
        c, s = -flat * np.cos(x), -flat * np.sin(x)
        # A rough power first, in single precision after whole turns are taken off: it is off by far less than n / 10 000,
        # so only periods that near to the largest can have it, and these few are done in double.
        power = np.zeros(grid)
        rough_c, rough_s = c.copy(), s.copy()
        for at in range(0, n, 500):
            turns = t[at : at + 500, None] / period
            angle = ((turns - np.rint(turns)) * (2 * np.pi)).astype(np.float32)
            rough_c += np.cos(angle).sum(0, dtype=np.float64)
            rough_s += np.sin(angle).sum(0, dtype=np.float64)
        rough = (rough_c * rough_c + rough_s * rough_s) / n
        fitting = (period >= median / 5) & (period <= window / 3)
        near = rough >= rough.max() - 1e-4 * n
        if fitting.any():
            near |= fitting & (rough >= rough[fitting].max() - 1e-4 * n)
        own_c, own_s = c[near], s[near]
        for at in range(0, n, 500):
            angle = t[at : at + 500, None] * omega[near]
            own_c += np.cos(angle).sum(0)
            own_s += np.sin(angle).sum(0)
        power[near] = (own_c**2 + own_s**2) / n
        return chosen(n, window, median, power, near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [strongest(np.array(ts_)) for ts_ in batch.column("_ts").to_pylist()]
            kept = batch.filter(pa.array([m is not None for m in made], pa.bool_()))
            figures = list(zip(*(m for m in made if m is not None))) or [()] * 7
            types = [pa.int64(), *[pa.float64()] * 6]
            columns = [kept.column(k) for k in keys] + [pa.array(list(f), t) for f, t in zip(figures, types)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    slots = df.sparkSession.sparkContext.defaultParallelism
    return held.repartition(2 * slots, *keys).mapInArrow(run, schema)
