"""The finding list: its parameter filters and its projection (PRED-18, PRED-23)."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions import exprs as E
from packetloom.functions import values as V
from packetloom.operators import matching

#: What the list shows; series and notes stay with the single finding.
LIST = (
    "id", "type", "severity", "score", "src_ip", "dst_ip", "dst_port", "detail", "timestamp", "source_file", "status", "analyst", "analyst_note",
    "status_ts", "ioc_match", "ioc_source", "is_new", "sensor",
)


@dataclass(frozen=True)
class Filters:
    """What a caller may ask for; an empty field asks for nothing."""

    type: str = ""
    severity: str = ""
    min_score: int = 0
    sub_scores: Mapping[str, tuple[float | None, float | None]] = field(default_factory=dict)  # ts_score: (low, high), ...
    ja3: str = ""
    ja4: str = ""
    sensor: str = ""
    src_ip: str = ""
    dst_ip: str = ""
    ports: tuple[str, ...] = ()
    since: str = ""  # only what was detected later
    time_from: str = ""
    time_to: str = ""
    zone: str = "UTC"
    search: str = ""
    status: str = ""
    include_dismissed: bool = False
    ioc_only: bool = False
    spectral_only: bool = False


@dataclass(frozen=True)
class Lists:
    """The operator's lists; those that are missing hide and mark nothing."""

    allowed: DataFrame | None = None  # value
    pairs: DataFrame | None = None  # src, dst, port, finding_type, sensor
    suppressed: DataFrame | None = None  # target, expiry
    now: float = 0.0
    indicators: DataFrame | None = None  # value, source, rank: the least rank names the source


def conditions(f: Filters) -> Column:
    """The filters that a finding's own columns answer."""
    out = F.lit(True)
    if f.type and f.type != "All":
        out = out & (F.col("type").isin(list(V.BEACONS)) if f.type == "beacons" else F.col("type") == f.type)
    if f.severity and f.severity != "All":
        out = out & (F.col("severity") == f.severity)
    out = out & (F.col("score") >= f.min_score)
    bounds = {c: b for c, b in f.sub_scores.items() if b != (None, None)}
    if bounds:  # sub-scores mean something for beacons only
        out = out & F.col("type").isin(list(V.BEACONS))
    for c, (low, high) in bounds.items():
        out = out & (F.col(c) >= low if low is not None else F.lit(True)) & (F.col(c) <= high if high is not None else F.lit(True))
    for c, value in (("ja3", f.ja3), ("ja4", f.ja4)):
        if value:
            out = out & E.fingerprint_is(c, value)
    if f.sensor:
        out = out & E.sensor_is(f.sensor)
    for c, value in (("src_ip", f.src_ip), ("dst_ip", f.dst_ip)):
        if value:
            out = out & E.ip_is(c, value)
    if f.ports:
        out = out & F.col("dst_port").isin(list(f.ports))
    if f.since:
        out = out & (F.col("detected_at") > f.since)
    at = F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss"))
    for text, after in ((f.time_from, True), (f.time_to, False)):
        if text:
            bound = F.to_utc_timestamp(F.lit(text).cast("timestamp"), f.zone)
            out = out & F.coalesce(at >= bound if after else at <= bound, F.lit(False))
    if f.search:
        out = out & _found(f.search.strip().lower())
    if f.status:
        out = out & E.status_is(f.status)
    elif not f.include_dismissed:
        out = out & (F.coalesce("status", F.lit("")) != "dismissed")
    if f.spectral_only:
        out = out & E.bool_is("spectral", "true")
    return out


def _found(text: str) -> Column:
    """A whole address equals a side, so that it doesn't find longer ones; other text is looked for in the shown columns."""
    whole = F.concat_ws(" ", "type", "src_ip", "dst_ip", "dst_port", "detail", "timestamp", "severity")
    return F.when(E.is_ip(F.lit(text)), (F.lower("src_ip") == text) | (F.lower("dst_ip") == text)).otherwise(F.contains(F.lower(whole), F.lit(text)))


def marked(findings: DataFrame, indicators: DataFrame | None) -> DataFrame:
    """``ioc_match`` and ``ioc_source``: the first list by rank that has either side; indicator types match by themselves."""
    rows = findings.drop("ioc_match", "ioc_source")
    best = F.lit(None).cast("struct<rank:int,source:string>")
    if indicators is not None:
        listed = indicators.select("value", "source", F.col("rank").cast("int").alias("rank"))
        hit = matching.side_matches(rows, listed).groupBy("_ip").agg(F.min(F.struct("rank", "source")).alias("_best"))
        for side in ("src_ip", "dst_ip"):
            rows = rows.join(hit.select(F.col("_ip").alias(side), F.col("_best").alias(f"_{side}")), side, "left")
        best = F.least("_src_ip", "_dst_ip")
    own = F.col("type").isin(list(V.INDICATOR_TYPES))
    rows = rows.withColumns({"ioc_match": best.isNotNull() | own, "ioc_source": F.coalesce(best["source"], F.when(own, "Threat Intel"))})
    return rows.drop("_src_ip", "_dst_ip").select(*(c for c in findings.columns if c not in ("ioc_match", "ioc_source")), "ioc_match", "ioc_source")


def filtered(findings: DataFrame, filters: Filters, lists: Lists = Lists()) -> DataFrame:
    """The findings that the filters leave and no list hides, marked with their indicator source (PRED-18)."""
    rows = findings.filter(conditions(filters))
    if lists.allowed is not None:
        rows = matching.hide_listed(rows, lists.allowed)
    if lists.suppressed is not None:
        rows = matching.hide_suppressed(rows, lists.suppressed, lists.now)
    if lists.pairs is not None:
        rows = matching.hide_pairs(rows, lists.pairs)
    rows = marked(rows, lists.indicators)
    return rows.filter("ioc_match") if filters.ioc_only else rows


def projected(findings: DataFrame, since: str, benign: DataFrame | None = None) -> DataFrame:
    """The list's columns, ``is_new_to_me`` by the caller's last visit, and ``tls_allowlisted`` (PRED-23)."""
    rows = findings if benign is None else matching.flag_benign(findings, benign)
    held = [c for c in LIST if c in rows.columns]
    flag = F.col("benign") if benign is not None else F.lit(False)
    return rows.select(*held, (F.col("detected_at") > since).alias("is_new_to_me"), flag.alias("tls_allowlisted"))
