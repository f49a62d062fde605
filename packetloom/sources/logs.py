"""Log scans (SRC-1..9): JSON lines and tab-separated files with headers, plain or gzip, into fixed columns.

Files are routed by base name and carry sensor, date and file from their path. Missing, ``-`` and
``(empty)`` are null; numbers that do not parse are null here and count as 0 where a rule says so.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions import exprs
from packetloom.schemas import LOGS


def _text(raw: Column) -> Column:
    return F.when(F.trim(raw).isin("-", "(empty)", ""), None).otherwise(raw)


def _cast(raw: Column, kind: str) -> Column:
    value = _text(raw)
    if kind == "boolean":
        return F.lower(value).isin("t", "true", "1")
    if kind == "set":  # an array in JSON, a comma list in text
        return F.regexp_replace(F.regexp_replace(value, r'^\[|\]$', ""), '"', "")
    return value if kind == "string" else value.try_cast("double").cast(kind)


def _located(df: DataFrame, default_sensor: str | None) -> DataFrame:
    """``sensor``, ``log_date`` and ``source_file`` from .../<sensor>/<YYYY-MM-DD>/<file>; archived files are left out."""
    path = F.col("source_file")
    found = lambda i: F.nullif(F.regexp_extract(path, r"/([^/]+)/(\d{4}-\d{2}-\d{2})/[^/]+$", i), F.lit(""))
    out = df.withColumns({"sensor": F.coalesce(found(1), F.lit(default_sensor)), "log_date": found(2).cast("date")})
    return out.filter(~F.contains(path, F.lit("/_archived/")))


@dataclass(frozen=True)
class Part:
    """The part of a folder of logs that is asked for: sensors, and days from ``since`` to ``until`` (YYYY-MM-DD, both included).

    Folders of other sensors and days, .../<sensor>/<day>/, are neither listed nor opened. ``spread`` deals the lines
    of compressed files, each of which one task reads, out to so many tasks before they are parsed.
    """

    sensors: Sequence[str] = ("*",)
    since: str | None = None
    until: str | None = None
    spread: int | None = None

    def folders(self, spark: SparkSession, path: str) -> list[str]:
        """The folders that there are, by patterns that the file system resolves itself."""
        if self.since is None and self.until is None and tuple(self.sensors) == ("*",):
            return [path]
        if (self.since is None) != (self.until is None):
            raise ValueError("give both ends of the days")
        days = ["*"]
        if self.since is not None:
            first, last = date.fromisoformat(self.since), date.fromisoformat(self.until)
            days = [str(first + timedelta(k)) for k in range((last - first).days + 1)]
        jvm, out = spark.sparkContext._jvm, []
        for pattern in (f"{path.rstrip('/')}/{s}/{d}" for s in self.sensors for d in days):
            at = jvm.org.apache.hadoop.fs.Path(pattern)
            found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
            out += [str(x.getPath()) for x in found or ()]
        return out


def _lines(spark: SparkSession, path: str, log: str, part: Part = Part()) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"{log}[._]*")
    if not (folders := part.folders(spark, path)):
        return spark.createDataFrame([], "value string, source_file string")
    out = reader.text(folders).select("value", F.col("_metadata.file_path").alias("source_file"))
    return out.repartition(part.spread) if part.spread else out


def read_json(spark: SparkSession, path: str, log: str, default_sensor: str | None = None, part: Part = Part()) -> DataFrame:
    """One JSON object per line; lines that do not parse are skipped."""
    lines = _lines(spark, path, log, part).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    wire = {w: k for w, k in LOGS[log].values()}
    schema = ", ".join(f"`{w}` STRING" for w in wire) + ", `_bad` STRING"
    parsed = lines.withColumn("r", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})).filter("r._bad IS NULL")
    cols = [_cast(F.col(f"r.`{w}`"), k).alias(n) for n, (w, k) in LOGS[log].items()]
    return _located(parsed.select(*cols, "source_file"), default_sensor)


def read_tsv(spark: SparkSession, path: str, log: str, default_sensor: str | None = None, part: Part = Part()) -> DataFrame:
    """Tab-separated lines under their file's ``#fields`` header; short rows are filled up with nulls."""
    lines = _lines(spark, path, log, part)
    heads = lines.filter(F.col("value").startswith("#fields")).groupBy("source_file").agg(F.min("value").alias("_h"))
    rows = lines.filter(~F.col("value").startswith("#") & (F.trim("value") != "")).join(heads, "source_file")
    names = F.slice(F.split("_h", "\t"), 2, 1_000)
    rows = rows.withColumns({"_n": names, "_v": F.split("value", "\t", -1)})
    cell = lambda w: F.get(F.col("_v"), F.when(F.array_position("_n", w) > 0, F.array_position("_n", w).cast("int") - 1))
    cols = [_cast(cell(w), k).alias(n) for n, (w, k) in LOGS[log].items()]
    return _located(rows.select(*cols, "source_file"), default_sensor)


def read(spark: SparkSession, path: str, log: str, default_sensor: str | None = None, fmt: str = "json", part: Part = Part()) -> DataFrame:
    """One kind of log as rows of fixed columns (SRC-1..6); ``part`` limits what is listed and opened."""
    out = (read_json if fmt == "json" else read_tsv)(spark, path, log, default_sensor, part)
    if log == "conn":  # payload bytes, else packet bytes
        pick = lambda a, b: F.when(F.coalesce(F.col(a), F.lit(0.0)) > 0, F.col(a)).otherwise(F.coalesce(F.col(b), F.col(a)))
        out = out.withColumns({"orig_bytes": pick("orig_bytes", "orig_ip_bytes"), "resp_bytes": pick("resp_bytes", "resp_ip_bytes")})
    return out


def file_ends(files: DataFrame) -> DataFrame:
    """File records with one sender (``tx``) and one receiver (``rx``); where a record has none, the connection's ends (``src``, ``dst``)."""
    held = lambda c: F.when(F.col(c) != "", F.col(c)) if c in files.columns else F.lit(None).cast("string")
    tx, rx = F.coalesce(exprs.first_address("tx"), held("src")), F.coalesce(exprs.first_address("rx"), held("dst"))
    return files.withColumns({"tx": tx, "rx": rx}).drop("src", "dst")


def quality(spark: SparkSession, path: str, log: str) -> DataFrame:
    """Data lines and parsed lines per file, JSON or with a header; a file without a parsed line is an error (SRC-7).

    A tab-separated line counts as parsed if its file has a header and it has a first value.
    """
    lines = _lines(spark, path, log).filter(F.trim("value") != "")
    data = ~F.col("value").startswith("#")
    json_ok = F.from_json("value", "ts STRING, `_bad` STRING", {"columnNameOfCorruptRecord": "_bad"})["_bad"].isNull()
    tab_ok = (F.size(F.split("value", "\t", -1)) > 1) & (F.get(F.split("value", "\t"), 0) != "")
    headed = F.count_if(F.col("value").startswith("#fields")) > 0
    out = lines.groupBy("source_file").agg(F.count_if(data).alias("lines"), F.when(headed, F.count_if(data & tab_ok)).otherwise(F.count_if(data & json_ok)).alias("parsed"))
    return out.withColumn("error", F.col("parsed") == 0)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files, bytes and newest time per sensor and date, from file listings only (SRC-8)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("source_file"), "length", "modificationTime")
    return _located(files, None).groupBy("sensor", "log_date").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.max("modificationTime").alias("newest"))


def dataset_fingerprint(spark: SparkSession, path: str) -> str:
    """One hash over all files' path, size and time; order does not matter (SRC-9)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    one = F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string")), 256)
    got = files.agg(F.bit_xor(F.xxhash64(one)).alias("x"), F.sum(F.pmod(F.xxhash64(one, F.lit(1)), F.lit(1 << 40))).alias("s"), F.count("*").alias("n")).first()
    return f"{(got.x or 0) & (2**64 - 1):016x}-{got.s or 0:x}-{got.n}"


def old_files(spark: SparkSession, path: str, cutoff: str) -> DataFrame:
    """Files of partitions older than the cutoff, by path date or else file time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("source_file"), "length", "modificationTime")
    rows = _located(files, None).withColumn("day", F.coalesce("log_date", F.to_date("modificationTime")))
    return rows.filter(F.col("day") < F.lit(cutoff).cast("date"))


def retention_plan(spark: SparkSession, path: str, cutoff: str) -> DataFrame:
    """Partitions older than the cutoff with counts and bytes (SNK-7, dry run); ``archive.copy`` is the job."""
    return old_files(spark, path, cutoff).groupBy("sensor", "day").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
