"""Exports of findings (SNK-1..5)."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions import exprs as E
from packetloom.functions import values as V

BASE = ("id", "type", "severity", "score", "src_ip", "dst_ip", "dst_port", "detail", "timestamp", "sensor", "status", "analyst")
BEACON = ("ts_score", "ds_score", "hist_score", "dur_score", "mean_interval", "median_interval", "jitter", "sample_size", "hostname", "uri")


def write_json(findings: DataFrame, path: str, lists: bool = True) -> None:
    drop = ["ts_data"] + ([] if lists else ["notes", "correlations", "top_uris"])
    findings.drop(*drop).write.mode("overwrite").json(path)


def guarded(c: str) -> Column:
    """Text that a spreadsheet would run is put behind an apostrophe."""
    text = F.col(c).cast("string")
    return F.when(text.rlike(r"^\s*[=+\-@]") | text.rlike(r"^[\t\r\n]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_rows(findings: DataFrame) -> DataFrame:
    text = {n for n, k in findings.dtypes if k == "string"}
    beacon = F.col("type").isin(list(V.BEACONS))
    base = [(guarded(c) if c in text else F.col(c)).alias(c) for c in BASE if c in findings.columns]
    return findings.select(*base, *(F.when(beacon, guarded(c) if c in text else F.col(c)).alias(c) for c in BEACON if c in findings.columns))


def write_csv(findings: DataFrame, path: str) -> None:
    csv_rows(findings).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def _header(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), r"\|", r"\\|"), r"[\r\n]+", " ")


def _value(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), "=", r"\\="), r"\r\n|\r|\n", r"\\n")


def cef_lines(findings: DataFrame, version: str = "1.0", most: int = 1023) -> DataFrame:
    """One event line per finding (SNK-3): severity 0-10 by score, techniques, whole segments up to a length."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    techniques = E.pick(F.col("type"), {t: ",".join(ids) for t, ids in V.TYPE_TECHNIQUES.items()})
    # Details are segments between bars: as many whole ones as fit.
    parts = F.split(text("detail"), r" \| ")
    kept = F.aggregate(parts, F.lit(""), lambda a, p: F.when(F.length(a) + F.length(p) + 3 > most, a).when(a == "", p).otherwise(F.concat(a, F.lit(" | "), p)))
    kept = F.when((kept == "") & (text("detail") != ""), F.substring(text("detail"), 1, most)).otherwise(kept)
    fields = {"src": text("src_ip"), "dst": text("dst_ip"), "dpt": text("dst_port"), "end": text("timestamp"), "cs1": techniques, "cs2": text("sensor"), "msg": kept}
    ext = F.concat_ws(" ", *(F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}="), _value(v))) for k, v in fields.items()))
    head = F.concat_ws("|", F.lit("CEF:0"), F.lit("packetloom"), F.lit("packetloom"), F.lit(version), _header(text("type")), _header(text("type")), F.least(F.lit(10), F.floor(F.col("score") / 10)).cast("string"))
    return findings.select(F.concat_ws("|", head, ext).alias("value"))


def triage(findings: DataFrame) -> DataFrame:
    """Verdict, confidence and reason from each finding's latest triage note (SNK-4)."""
    note = F.element_at(F.filter("notes", lambda n: F.lower(n).startswith("triage:")), -1)
    rows = findings.filter(F.exists("notes", lambda n: F.lower(n).startswith("triage:"))).withColumn("note", note)
    take = lambda name, p: F.nullif(F.regexp_extract("note", rf"(?i){name}\s*[:=]\s*{p}", 1), F.lit(""))
    return rows.select("id", F.lower(take("verdict", r"([A-Za-z_ -]+?)(?=[;,.\n]|$)")).alias("verdict"), take("confidence", r"(\d+)").cast("int").alias("confidence"), take("reason", r"([^\n]+)").alias("reason"))


def triage_lines(findings: DataFrame, version: str = "1.0", most: int = 1023, spelled: bool = False) -> DataFrame:
    """One event line per finding with a verdict (SNK-4): who, what was decided, how surely and why.

    Sides that are no address are left out; ``spelled`` keeps those that are only written like one.
    """
    rows = findings.join(triage(findings), "id").filter("verdict IS NOT NULL")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    said = F.concat(
        text("verdict"),
        F.when(F.col("confidence").isNotNull(), F.concat(F.lit(" ("), text("confidence"), F.lit(")"))).otherwise(""),
        F.when(text("reason") != "", F.concat(F.lit(" - "), text("reason"))).otherwise(""),
    )
    techniques = E.pick(F.col("type"), {t: ",".join(ids) for t, ids in V.TYPE_TECHNIQUES.items()})
    side = lambda c: F.when((E.is_spelled_ip if spelled else E.is_ip)(c), text(c)).otherwise("")
    fields = {
        "externalId": text("id"),
        "src": side("src_ip"),
        "dst": side("dst_ip"),
        "dpt": F.when(text("dst_port").rlike(r"^\d+$"), text("dst_port")).otherwise(""),
        "msg": F.substring(said, 1, most),
        "cs1": text("score"),
        "cs2": text("verdict"),
        "cs3": text("confidence"),
        "cs4": text("type"),
        "cs5": techniques,
        "end": text("timestamp"),
    }
    ext = F.concat_ws(" ", *(F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{k}="), _value(v))) for k, v in fields.items()))
    name = F.concat(F.lit("Triage #"), text("id"), F.lit(": "), text("verdict"))
    head = F.concat_ws("|", F.lit("CEF:0"), F.lit("packetloom"), F.lit("packetloom"), F.lit(version), F.lit("triage"), _header(name), F.least(F.lit(10), F.floor(F.col("score") / 10)).cast("string"))
    return rows.select(F.concat_ws("|", head, ext).alias("value"))


def write_text(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)


_POINTERS = "version string, at long, job string, batch long"


def publish(findings: DataFrame, root: str, job: str | None = None, batch: int | None = None) -> str:
    """A new version of the findings table, partitioned by type (SNK-5).

    A pointer of its own is added when the version is whole; nothing is overwritten, so the table that was
    current stays readable whatever happens in between. The pointer says which batch of which job made the
    version, so ``applied`` is the ledger of batches and can't disagree with the table.
    """
    spark, version = findings.sparkSession, f"v-{uuid4().hex}"
    findings.write.partitionBy("type").parquet(f"{root}/{version}")
    at = spark.range(1).select(F.lit(version).alias("version"), F.unix_micros(F.current_timestamp()).alias("at"), F.lit(job).cast("string").alias("job"), F.lit(batch).cast("long").alias("batch"))
    at.coalesce(1).write.mode("append").parquet(f"{root}/_pointers")
    return version


def pointers(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_POINTERS).parquet(f"{root}/_pointers")


def applied(spark: SparkSession, root: str, job: str, batch: int) -> bool:
    """Whether a version was published by this batch."""
    return not pointers(spark, root).filter((F.col("job") == job) & (F.col("batch") == batch)).isEmpty()


def current(spark: SparkSession, root: str) -> DataFrame:
    """The version that the newest pointer names."""
    newest = pointers(spark, root).agg(F.max_by("version", F.struct("at", "version"))).first()[0]
    return spark.read.parquet(f"{root}/{newest}")
