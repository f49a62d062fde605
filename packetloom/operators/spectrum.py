"""The strongest period of keys of any size over all of their timestamps (STAT-11)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from packetloom.config import DEFAULT, Config
from packetloom.operators import order, stats
from packetloom.sources.scratch import written


def periodicity(df: DataFrame, keys: Sequence[str], ts: str = "ts", grid: int = 2000, cfg: Config = DEFAULT, gated: DataFrame | None = None, gathered: int = 10_000) -> DataFrame:
    """``stats.periodicity`` without a bound on the timestamps: keys with up to ``gathered`` of them are a row, larger ones are dealt out."""
    keys = list(keys)
    rows = df.select(*keys, F.col(ts).cast("double").alias("_t")).filter("_t IS NOT NULL")
    if gated is not None:
        rows = rows.join(gated.select(*keys).distinct(), keys, "left_semi")
    enough = written(rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") >= cfg.spectral_min_observations), "enough")
    fits = F.col("_n") <= gathered
    found = stats.periodicity(rows, keys, "_t", grid, cfg, last=None, gated=enough.filter(fits))
    large = enough.filter(~fits)
    return found if large.isEmpty() else found.unionByName(_large(rows.join(large.select(*keys), keys, "left_semi"), keys, grid, cfg, gathered))


def _large(rows: DataFrame, keys: Sequence[str], grid: int, cfg: Config, gathered: int) -> DataFrame:
    """Sums over the grid are additive: each share of a key's timestamps has its own, and they are added period by period."""
    times = written(rows.groupBy(*keys, "_t").agg(F.count("*").alias("_c")), "times")
    spans = times.groupBy(*keys).agg(F.sum("_c").alias("n"), F.count("*").alias("_d"), F.min("_t").alias("_first"), (F.max("_t") - F.min("_t")).alias("_window")).filter("_window >= 10")
    median = order.median(stats.blocked(times, keys, "_t").select(*keys, "iv"), keys, "iv").withColumnRenamed("median", "median_iv")
    spans = written(spans.join(median, keys), "spans")
    share = F.pmod(F.xxhash64("_t"), F.ceil(F.col("_d") / gathered).cast("long"))
    shares = times.join(spans, keys).groupBy(*keys, "_window", share.alias("_share")).agg(F.collect_list(F.struct((F.col("_t") - F.col("_first")).alias("t"), F.col("_c").cast("double").alias("c"))).alias("_ts"))
    periods, beyond, chosen = stats.peaks(grid, cfg.spectral_threshold)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, window in enumerate(batch.column("_window").to_pylist()):
                t, c = (x.to_numpy(zero_copy_only=False) for x in batch.column("_ts").slice(i, 1).flatten().flatten())
                omega, cos, sin = 2 * np.pi / periods(window), np.zeros(grid), np.zeros(grid)
                for at in range(0, len(t), 500):
                    angle = t[at : at + 500, None] * omega
                    cos += c[at : at + 500] @ np.cos(angle)
                    sin += c[at : at + 500] @ np.sin(angle)
                one = [batch.column(k).slice(i, 1) for k in keys]
                yield pa.RecordBatch.from_arrays([*one, pa.array([cos.tolist()], pa.list_(pa.float64())), pa.array([sin.tolist()], pa.list_(pa.float64()))], names=[*keys, "cos", "sin"])

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for i, (n, window, median) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "_window", "median_iv")))):
                _, cos, sin = (x.to_numpy(zero_copy_only=False) for x in batch.column("_sums").slice(i, 1).flatten().flatten())
                made.append(chosen(n, window, median, beyond(cos, sin, n, window), np.ones(grid, bool)))
            columns = [batch.column(k) for k in keys] + [pa.array(list(f), t) for f, t in zip(list(zip(*made)) or [()] * 7, [pa.int64(), *[pa.float64()] * 6])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    of_keys = [rows.schema[k] for k in keys]
    arrays = [StructField(c, ArrayType(DoubleType())) for c in ("cos", "sin")]
    sums = shares.mapInArrow(summed, StructType([*of_keys, *arrays])).select(*keys, F.posexplode(F.arrays_zip("cos", "sin")).alias("_at", "_s"))
    sums = sums.groupBy(*keys, "_at").agg(F.sum("_s.cos").alias("cos"), F.sum("_s.sin").alias("sin"))
    sums = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", "cos", "sin"))).alias("_sums"))
    schema = stats.period_schema(of_keys)
    names = schema.names
    return sums.join(spans, keys).mapInArrow(judged, schema)
