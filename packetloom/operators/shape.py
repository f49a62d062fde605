"""Order statistics of keys that fit into a row (STAT-2, 3), for all keys of an Arrow batch at once."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, StructField, StructType

from packetloom.operators.stats import BUCKETS

# Tasks get these functions themselves: executors need not have the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What ``shaped`` adds, and what besides where there are hours.
SHAPES, RHYTHMS = ("median_iv", "_raw", "_mm", "_ds"), ("hist_score", "bars", "longest")


def _starts(n: np.ndarray) -> np.ndarray:
    return np.cumsum(n) - n


def _medians(v: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of sorted segments of ``v``; 0 for empty ones."""
    out, held = np.zeros(len(n)), n > 0
    at, size = start[held], n[held]
    out[held] = (v[at + (size - 1) // 2] + v[at + size // 2]) / 2
    return out


def _sorted(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each segment sorted by itself; segments follow one another."""
    return v[np.lexsort((v, np.repeat(np.arange(len(n)), n)))]


def _bowley(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    start, half = _starts(n), n // 2
    q1, q2, q3 = _medians(v, start, half), _medians(v, start, n), _medians(v, start + n - half, half)
    flat = (n < 3) | (q3 - q1 < 0.05 * q2) | (q2 == q1) | (q2 == q3)
    return np.where(flat, 1.0, 1.0 - np.abs((q1 + q3 - 2 * q2) / np.where(flat, 1.0, q3 - q1)))


def _mad(v: np.ndarray, n: np.ndarray, default: float) -> np.ndarray:
    med = _medians(v, _starts(n), n)
    off = _medians(_sorted(np.abs(v - np.repeat(med, n)), n), _starts(n), n)
    none = (n == 0) | (med == 0)
    return np.where(none, default, np.clip((med - off) / np.where(none, 1.0, med), 0.0, 1.0))


def _regularity(v: np.ndarray, n: np.ndarray, default: float) -> np.ndarray:
    return (_bowley(v, n) + _mad(v, n, default)) / 2


def _multimodal(v: np.ndarray, bucket: np.ndarray, n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``stats.multimodal``: buckets with half the largest count are peaks, and neighbouring peaks are one mode."""
    peak = (counts > 0) & (counts >= counts.max(1, keepdims=True) * 0.5)
    begins = peak & ~np.pad(peak, ((0, 0), (1, 0)))[:, :-1]
    number, modes = begins.cumsum(1) - 1, begins.sum(1)
    row = np.repeat(np.arange(len(n)), n)
    inside = peak[row, bucket]
    size = np.bincount(row[inside] * BUCKETS + number[row[inside], bucket[inside]], minlength=len(n) * BUCKETS)
    tight = _mad(v[inside], size, 0.0).reshape(-1, BUCKETS)
    size = size.reshape(-1, BUCKETS)
    real = np.arange(BUCKETS) < modes[:, None]
    good = (n >= 6) & (modes >= 2) & (modes <= 4) & (~real | ((size >= 2) & (tight >= 0.5))).all(1)
    return np.where(good, (tight * size).sum(1) / np.maximum(size.sum(1), 1), 0.0)


def _daily(row: np.ndarray, hour: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
    """``hist_score``: even use of the hours of day, or the share of them in use; records without an hour are a bar of their own."""
    place = np.where(np.isnan(hour), 24, np.mod(hour, 24)).astype(np.int64)
    count = np.bincount(row * 25 + place, n, rows * 25).reshape(-1, 25)
    used = count > 0
    bars = used.sum(1)
    mean = count.sum(1) / np.maximum(bars, 1)
    sd = np.sqrt((np.square(count - mean[:, None]) * used).sum(1) / np.maximum(bars, 1))
    high = (used & (count >= count.max(1, keepdims=True) * 0.05)).sum(1)
    even = np.where((bars < 2) | (sd >= mean), 0.0, 1 - sd / np.where(mean > 0, mean, 1.0))
    share = np.where((bars < 11) | (high < 2), 0.0, high / np.maximum(bars, 1))
    return np.maximum(even, share)


def _runs(row: np.ndarray, hour: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many of the recent window's 24 bins a key is in, and its longest run of them; records without an hour are in the last."""
    width = np.where(end > begin, end - begin, np.nan)
    place = np.trunc((hour * 3600.0 - begin[row]) / width[row] * 24)
    bins = np.clip(np.where(np.isnan(place), 23, place), 0, 23).astype(np.int64)
    held = np.bincount(row * 24 + bins, minlength=len(begin) * 24).reshape(-1, 24) > 0
    held &= (end > begin)[:, None]
    run = longest = np.zeros(len(begin), np.int64)
    for b in range(24):
        run = (run + 1) * held[:, b]
        longest = np.maximum(longest, run)
    return held.sum(1), longest


def shaped(series: DataFrame) -> DataFrame:
    """``median_iv``, ``_raw`` and ``_ds`` (regularity of intervals and sizes, not yet rounded) and ``_mm`` in place of the values.

    ``series`` has ``ivs`` (iv, bucket), ``sizes`` and ``counts`` of the buckets. With ``hours`` (hour, n) and the recent window's
    ``begin`` and ``win_max``, ``hist_score``, ``bars`` and ``longest`` are added. A key is one row, so nothing here crosses rows.
    """
    kept = [c for c in series.columns if c not in ("ivs", "sizes", "hours", "begin")]
    with_hours = "hours" in series.columns
    names = SHAPES + RHYTHMS if with_hours else SHAPES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ivs, sizes = batch.column("ivs"), batch.column("sizes")
            n, m = (x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) for x in (ivs, sizes))
            iv, bucket = (x.to_numpy(zero_copy_only=False) for x in ivs.flatten().flatten())
            order = np.lexsort((iv, np.repeat(np.arange(len(n)), n)))
            iv, bucket = iv[order], bucket[order].astype(np.int64)
            size = _sorted(sizes.flatten().to_numpy(zero_copy_only=False), m)
            counts = batch.column("counts").flatten().to_numpy(zero_copy_only=False).reshape(-1, BUCKETS)
            figures = (_medians(iv, _starts(n), n), _regularity(iv, n, 1.0), _multimodal(iv, bucket, n, counts), np.where(m >= 3, _regularity(size, m, 0.0), 0.0))
            if with_hours:
                row = np.repeat(np.arange(len(n)), batch.column("hours").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                hour, times = (x.to_numpy(zero_copy_only=False).astype(np.float64) for x in batch.column("hours").flatten().flatten())
                begin, end = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("begin", "win_max"))
                figures += (_daily(row, hour, times, len(n)), *_runs(row, hour, begin, end))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(x, pa.float64()) for x in figures], names=[*kept, *names])

    schema = StructType([*(series.schema[c] for c in kept), *(StructField(c, DoubleType()) for c in names)])
    return series.mapInArrow(run, schema)
