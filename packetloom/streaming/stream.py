"""Streams (STR): incremental passes over arriving logs with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packetloom.functions import exprs as E
from packetloom.operators.matching import asked, fits, indicator_hits, listed
from packetloom.sources import sinks


def arriving(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they land; the checkpoint, not file times, says what is new (STR-1)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def with_time(stream: DataFrame, ts: str = "ts", late: str = "5 minutes") -> DataFrame:
    return stream.withColumn("at", F.timestamp_seconds(F.col(ts))).withWatermark("at", late)


def matched(stream: DataFrame, indicators: DataFrame, dst: str = "dst") -> DataFrame:
    """New records whose destination is an indicator, an exact one, a range or a wildcard (STR-2): one stream-static join by keys.

    A record asks by its own spelling, by its prefixes of the lengths that occur and by its pieces; the
    static side follows its statistics. A record that several entries of a feed match comes once for each.
    """
    ready = listed(indicators.select("value", "feed", "score"))
    entries = ready.keys.select("_p", "_like", "feed", "score")
    return stream.withColumn("_p", F.explode(asked(dst, ready))).join(entries, "_p").filter(fits(dst)).drop("_p", "_like")


def first_seen(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first record of each key within the watermark (STR-3)."""
    return stream.dropDuplicatesWithinWatermark(list(keys))


def tumbling(stream: DataFrame, keys: Sequence[str], size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and bytes per key and window: the additive part of a pair's state (STR-5, STR-9)."""
    window = F.window("at", size, slide) if slide else F.window("at", size)
    return stream.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("orig_bytes").alias("orig_bytes"), F.min("ts").alias("first"), F.max("ts").alias("last"))


STATE = "n long, last double, gaps long, total double, squares double"


def intervals(stream: DataFrame, keys: Sequence[str] = ("sensor", "src", "dst"), idle_hours: float = 168.0) -> DataFrame:
    """Running interval statistics per key (STR-4, STR-5): counts and moments, never the records.

    A batch's records are sorted first, and a record before the latest one does not rewind the state. With a
    watermark (``with_time``), a pair that is silent for ``idle_hours`` of event time leaves the state.
    """
    timed = "at" in stream.columns

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last, gaps, total, squares = state.get if state.exists else (0, float("-inf"), 0, 0.0, 0.0)
        ts = np.sort(np.concatenate([b["ts"].to_numpy(np.float64) for b in batches]))
        new = ts[ts > last]
        steps = np.diff(np.concatenate([[last], new])) if n else np.diff(new)
        steps = steps[steps > 0]
        n, gaps, total, squares = n + len(ts), gaps + len(steps), total + float(steps.sum()), squares + float(steps @ steps)
        last = float(new[-1]) if len(new) else last
        state.update((n, float(last), gaps, total, squares))
        if timed:
            state.setTimeoutTimestamp(max(int((last + idle_hours * 3600) * 1000), state.getCurrentWatermarkMs() + 1))
        mean = total / gaps if gaps else None
        cv = (max(squares / gaps - mean * mean, 0.0) ** 0.5 / mean) if gaps and mean else None
        yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, "n": [n], "last": [last], "mean_iv": [mean], "cv": [cv]}).astype({"mean_iv": "float64", "cv": "float64"})

    out = ", ".join(f"{k} string" for k in keys) + ", n long, last double, mean_iv double, cv double"
    timeout = GroupStateTimeout.EventTimeTimeout if timed else GroupStateTimeout.NoTimeout
    return stream.groupBy(*keys).applyInPandasWithState(update, out, STATE, "update", timeout)


def merged(stream: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None], name: str | None = None) -> StreamingQuery:
    """Every micro-batch into a merge job, once; stops when what has arrived is done (STR-6)."""
    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def upserted(stream: DataFrame, checkpoint: str, root: str, job: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> StreamingQuery:
    """Every micro-batch merged into the published findings table exactly once (STR-6): ``merge(table, batch)`` gives the new table.

    Spark repeats a batch that it doesn't know to be done. The pointer that publishes a version also names its
    batch: a batch that has one is skipped, and one that failed before has left the table as it was.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if not sinks.applied(spark, root, job, number):
            sinks.publish(merge(sinks.current(spark, root), batch), root, job, number)

    return merged(stream, checkpoint, apply)


def stale(latest: DataFrame, now: float, limit: float, active: DataFrame | None = None) -> DataFrame:
    """Sources whose newest record is too old, each alarm raised once while it lasts (STR-7)."""
    late = latest.groupBy("sensor").agg(F.max("ts").alias("last")).withColumn("silent", F.lit(now) - F.col("last")).filter(F.col("silent") > limit)
    return late if active is None else late.join(active.select("sensor").distinct(), "sensor", "left_anti")


def failing_feeds(feeds: DataFrame, now: float, limit: float, failures: int = 3) -> DataFrame:
    """Feeds that failed several times in a row or have not refreshed for too long."""
    why = F.when(F.col("failures") >= failures, "failing").when(F.lit(now) - F.col("refreshed") > limit, "stale")
    return feeds.withColumn("alarm", why).filter("alarm IS NOT NULL")


def rescan(archive: DataFrame, indicators: DataFrame) -> DataFrame:
    """Archived records against new indicators: the batch job over other partitions (STR-8)."""
    return indicator_hits(archive, indicators)


def host_kind(stream: DataFrame, dst: str = "dst") -> DataFrame:
    return stream.withColumn("dst_class", E.host_class(dst))
