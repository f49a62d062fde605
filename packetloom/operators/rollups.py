"""Roll-ups of findings per pair, destination and host (DET-40..43)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions import exprs as E
from packetloom.functions import values as V
from packetloom.sources.scratch import written

FINGERPRINT = ("type", "src_ip", "dst_ip", "dst_port", "sensor", "hostname", "uri", "channel")


def fingerprint(df: DataFrame) -> DataFrame:
    """``fp``: a finding's identity; host and URI count for HTTP beacons only, the channel where it is set."""
    parts = []
    for c in FINGERPRINT:
        v = F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
        if c in ("hostname", "uri"):
            v = F.when(F.col("type") == "HTTP Beacon", v).otherwise("")
        parts.append(F.replace(v, F.lit("\x1f"), F.lit("")))
    return df.withColumn("fp", F.sha2(F.concat_ws("\x1f", *parts), 256))


def together(current: DataFrame, history: DataFrame | None) -> DataFrame:
    """Current and historical findings, one per identity: the current one wins (SET-1)."""
    if history is None:
        return fingerprint(current)
    both = current.withColumn("_p", F.lit(0)).unionByName(history.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c != "_p"]
    best = fingerprint(both).groupBy("fp").agg(F.min_by(F.struct(*cols), F.struct("_p", (-F.col("score")).alias("s"))).alias("f"))
    return best.select("fp", "f.*")


#: Types that take no part in a correlation beside the roll-ups, and sources and destinations that stand for no host.
UNCORRELATED = ("Zeek Notice", "Long Connection")
NO_SOURCE, NO_DESTINATION = ("", "(cert)", "(escalation)", "(TI)"), ("", "(network)")

CORROBORATING = ("Lateral Movement", "TI Hit (IP)", "Malicious JA3", "Malicious JA4")


class Rollup(NamedTuple):
    """Roll-up findings, and who is in them: one row per member (``rollup_fp``, ``rollup``, ``fp``, ``member``, ``historical``).

    ``member`` is a finding's id, of the history where only that has it (``historical``); ``rollup`` is the
    roll-up's id. Both tables grow with the members: no row lists the others.
    """

    findings: DataFrame
    members: DataFrame


def numbered(rows: DataFrame, start: DataFrame, key: str = "fp") -> DataFrame:
    """``rows`` with gapless ids behind the one row of ``start`` (``_top``), in the order of a hexadecimal key.

    Counts per block of keys first, then places within each block: no task sees all rows.
    """
    rows = rows.withColumn("_b", F.conv(F.substring(key, 1, 3), 16, 10).cast("int"))  # 4096 blocks
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    out = rows.withColumn("_p", place).join(F.broadcast(offsets), "_b").join(F.broadcast(start))  # 4096 rows and one
    return out.withColumn("id", (F.col("_top") + F.col("_o") + F.col("_p")).cast("long")).drop("_b", "_o", "_p", "_top")


def _signed(current: DataFrame, history: DataFrame | None, *columns: str) -> DataFrame:
    """Findings of a run and of the history with ``fp``, and ``_p`` (0: the run) as precedence."""
    wanted = [c for c in dict.fromkeys(("id", *FINGERPRINT, "score", "timestamp", *columns)) if c in current.columns]
    rows = fingerprint(current).select("fp", *wanted, F.lit(0).alias("_p"))
    if history is None:
        return rows
    return rows.unionByName(fingerprint(history).select("fp", *(c for c in wanted if c in history.columns), F.lit(1).alias("_p")), allowMissingColumns=True)


def _member() -> tuple[Column, Column]:
    """The id of the row that speaks for an identity, the run's first or else the history's, and which of them it is."""
    return F.min_by("id", F.struct("_p", "id")).alias("member"), (F.min("_p") == 1).alias("historical")


def _top(current: DataFrame) -> DataFrame:
    return current.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))


def _rollup_row(out: DataFrame, kind: str) -> DataFrame:
    """The identity of roll-up rows (sensor, src_ip, dst_ip), which have no port."""
    return fingerprint(out.withColumns({"type": F.lit(kind), "dst_port": F.lit("")}))


def correlated(current: DataFrame, history: DataFrame | None = None, least_types: int = 2) -> Rollup:
    """Pairs of hosts, as one sensor saw them, with several types of findings (DET-40), and their members (DET-41).

    A run and the history count together, one finding per identity, the run's first. The score is the best
    one and five more per further type. With ``least_types`` under two there are no correlations.
    """
    pair = ["sensor", "src_ip", "dst_ip"]
    rows = _signed(current, history).withColumn("sensor", F.coalesce("sensor", F.lit("")))
    rows = rows.filter(~F.col("type").isin([*V.ROLLUPS, *UNCORRELATED]) & ~F.coalesce("src_ip", F.lit("")).isin(*NO_SOURCE) & ~F.coalesce("dst_ip", F.lit("")).isin(*NO_DESTINATION) & F.lit(least_types >= 2))
    at = F.when(F.col("timestamp") != "", F.col("timestamp"))
    each = rows.groupBy("fp", *pair, "type").agg(F.max("score").alias("score"), F.min(at).alias("at"), *_member())
    each = written(each, "correlated-each")  # read for the pairs, for their numbers and for the members
    # Types per pair first: few rows, so a busy pair is summed up before it is shuffled.
    kinds = each.groupBy(*pair, "type").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.min("at").alias("first"))
    out = kinds.groupBy(*pair).agg(
        F.count("*").alias("n_types"), F.max("best").alias("best"), F.min("first").alias("timestamp"), F.sum("n").alias("n_members"), F.array_join(F.sort_array(F.collect_list("type")), ", ").alias("types")
    )
    out = out.filter(F.col("n_types") >= least_types)
    score = F.least(F.lit(99), F.col("best") + 5 * (F.col("n_types") - least_types)).cast("int")
    detail = F.format_string("Multi-stage activity on (%s \u2192 %s) \u2014 %s | Contributing findings: %d", "src_ip", "dst_ip", "types", "n_members")
    out = out.withColumns({"score": score, "severity": E.ladder(score, 80, 60, 40), "detail": detail})
    found = numbered(_rollup_row(out, "Correlated Activity"), _top(current)).select("fp", "id", "type", "severity", "score", *pair, "dst_port", "timestamp", "detail", "n_types", "n_members", "types")
    found = written(found, "correlated")
    members = each.select(*pair, "fp", "member", "historical").join(found.select(*pair, F.col("fp").alias("rollup_fp"), F.col("id").alias("rollup")), pair)
    return Rollup(found, members.select("rollup_fp", "rollup", "fp", "member", "historical"))


def with_rollup(current: DataFrame, members: DataFrame) -> DataFrame:
    """Findings of the run with the id of the correlation they are in; what was there before goes (DET-41)."""
    held = members.filter("NOT historical").select(F.col("member").alias("id"), "rollup")
    return current.drop("rollup").join(held, "id", "left")


def siblings_of(ids: DataFrame, members: DataFrame) -> DataFrame:
    """(id, sibling): the other members of the roll-ups that the given findings are in; made when asked for, never stored."""
    asked = members.join(ids.select(F.col("id").alias("member")).distinct(), "member", "left_semi").select("rollup_fp", F.col("fp").alias("_fp"), F.col("member").alias("id"))
    return members.select("rollup_fp", "fp", F.col("member").alias("sibling")).join(asked, "rollup_fp").filter("fp != _fp").select("id", "sibling").distinct()


def staged(current: DataFrame, history: DataFrame | None, sources: DataFrame, least_hosts: int = 2, most_sources: int = 6, hours: float = 48) -> Rollup:
    """Several internal hosts that began to beacon to one rare external destination, one after the other (DET-42).

    Beacon findings of the run and of the history take part, one per identity, the run's first. ``sources``
    (sensor, dst, n_sources) says how many sources talked to a destination: one that more than
    ``most_sources`` know isn't rare; one it doesn't have counts as rare. The hosts' onsets lie within
    ``hours``. Members are the beacons of the run and of the history. The finding names its
    first hosts; the members name them all.

    A cluster counts as confirmed by (JOIN-16): lateral movement between two of its hosts seen by the same sensor, or an
    indicator hit or a known-bad TLS client on its destination. The first of them is the reason.
    """
    keys = ["sensor", "dst_ip"]
    rows = _signed(current, history).withColumn("sensor", F.coalesce("sensor", F.lit("")))
    usable = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    beacons = rows.filter(F.col("type").isin(list(V.BEACONS)) & usable("src_ip") & usable("dst_ip") & usable("timestamp") & ~E.is_private("dst_ip"))
    first = F.struct("_p", "id")
    each = beacons.groupBy("fp", *keys, "src_ip").agg(F.min_by("timestamp", first).alias("at"), *_member())
    hosts = each.groupBy(*keys, "src_ip").agg(F.min("at").alias("onset"))
    order = F.struct("onset", "src_ip")
    clusters = hosts.groupBy(*keys).agg(F.count("*").alias("n_hosts"), F.min("onset").alias("timestamp"), F.max("onset").alias("last"), F.min_by("src_ip", order).alias("src_ip"))
    known = sources.select(F.coalesce("sensor", F.lit("")).alias("sensor"), F.col("dst").alias("dst_ip"), "n_sources")
    clusters = clusters.filter(F.col("n_hosts") >= least_hosts).join(known, keys, "left").filter(F.coalesce("n_sources", F.lit(0)) <= most_sources).drop("n_sources")
    at = lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")).cast("double")
    clusters = clusters.filter(at("last") - at("timestamp") <= hours * 3600)
    parts = hosts.join(clusters.select(*keys), keys, "left_semi")
    named = parts.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("onset", "src_ip"))).filter(F.col("_r") <= NAMED)
    named = named.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(order)), lambda x: F.concat(x["src_ip"], F.lit("@"), x["onset"])), " ").alias("named"))
    reasons = _reasons(rows.filter(F.col("type").isin(*CORROBORATING)), parts, clusters)
    out = clusters.join(named, keys).join(reasons, keys, "left")
    sure = F.col("reason").isNotNull()
    more = F.when(F.col("n_hosts") > NAMED, F.format_string(" and %d more", F.col("n_hosts") - NAMED)).otherwise("")
    detail = F.concat(
        F.format_string("%d internal hosts converging on external %s \u2014 staged beacon onsets: %s", "n_hosts", "dst_ip", "named"), more, F.when(sure, F.concat(F.lit(" | corroboration: "), "reason")).otherwise("")
    )
    out = out.withColumns({"score": F.when(sure, 96).otherwise(80), "severity": F.when(sure, "CRITICAL").otherwise("HIGH"), "detail": detail})
    found = numbered(_rollup_row(out, "Multi-Stage Beacon"), _top(current)).select("fp", "id", "type", "severity", "score", "sensor", "src_ip", "dst_ip", "dst_port", "timestamp", "detail", "n_hosts", "reason")
    members = each.select(*keys, "fp", "member", "historical").join(found.select(*keys, F.col("fp").alias("rollup_fp"), F.col("id").alias("rollup")), keys)
    return Rollup(found, members.select("rollup_fp", "rollup", "fp", "member", "historical"))


#: Hosts that a staging finding's text names.
NAMED = 50


def _reasons(related: DataFrame, parts: DataFrame, clusters: DataFrame) -> DataFrame:
    """(sensor, dst_ip, reason): what confirms each cluster first, in the order of the run's ids, then the history's.

    Lateral movement is held against the hosts of each cluster by two equi joins, so it counts only where
    both ends are in one cluster. Only the first of equal reasons can be a cluster's first one, so the rows of a move or of
    a hit are reduced to it before they meet the clusters: the joins grow with the clusters, not with clusters times findings.
    """
    keys = ["sensor", "dst_ip"]
    host = lambda side: parts.select(*keys, F.col("src_ip").alias(side))
    moved = _moves(related).join(host("a"), ["sensor", "a"]).join(host("b"), [*keys, "b"]).select(*keys, "_p", "id", F.concat(F.lit("lateral movement "), "a", F.lit("\u2192"), "b").alias("reason"))
    hit = _hits(related).join(clusters.select(*keys), "dst_ip").select(*keys, "_p", "id", "reason")
    return moved.unionByName(hit).groupBy(*keys).agg(F.min_by("reason", F.struct("_p", "id", "reason")).alias("reason"))


def _moves(related: DataFrame) -> DataFrame:
    """(sensor, a, b, _p, id): the first lateral movement between two hosts."""
    rows = related.filter("type = 'Lateral Movement'").groupBy("sensor", F.col("src_ip").alias("a"), F.col("dst_ip").alias("b"))
    return rows.agg(F.min(F.struct("_p", "id")).alias("f")).select("sensor", "a", "b", "f.*")


def _hits(related: DataFrame) -> DataFrame:
    """(dst_ip, reason, _p, id): the first indicator hit, and the first of each kind of bad client, on a destination."""
    ends = F.when(F.col("type") == "TI Hit (IP)", F.array_distinct(F.array("dst_ip", "src_ip"))).otherwise(F.array("dst_ip"))
    text = F.concat(F.when(F.col("type") == "TI Hit (IP)", "TI hit").otherwise(F.col("type")), F.lit(" on C2 destination")).alias("reason")
    rows = related.filter("type != 'Lateral Movement'").select("_p", "id", text, F.explode(ends).alias("dst_ip")).groupBy("dst_ip", "reason")
    return rows.agg(F.min(F.struct("_p", "id")).alias("f")).select("dst_ip", "reason", "f.*")


def destination_sources(conn: DataFrame) -> DataFrame:
    """(sensor, dst, n_sources): how many internal sources each destination has in the logs."""
    return conn.filter(E.is_private("src")).groupBy("sensor", "dst").agg(F.countDistinct("src").alias("n_sources"))


def host_risk(findings: DataFrame) -> DataFrame:
    """A source's types, weighted by score and number of destinations, damped towards 99 (DET-43)."""
    rows = findings.filter(~F.col("src_ip").startswith("(") & (F.col("src_ip") != "") & ~F.col("type").isin(list(V.ROLLUPS)))
    per = rows.groupBy("src_ip", "type").agg(F.max("score").alias("best"), F.countDistinct("dst_ip").alias("dsts"), F.min("timestamp").alias("first"))
    weight = E.pick(F.col("type"), V.RISK_WEIGHTS)
    many = F.least(F.lit(3.0), 1.0 + 0.5 * F.log2(F.greatest(F.col("dsts"), F.lit(1)).cast("double")))
    part = F.round(weight * (0.5 + 0.5 * F.col("best") / 100.0) * many).cast("int")
    name = F.when(F.col("dsts") > 1, F.concat("type", F.lit("x"), F.col("dsts").cast("string"))).otherwise(F.col("type"))
    out = per.groupBy("src_ip").agg(F.sum(F.coalesce(part, F.lit(0))).alias("raw"), F.min("first").alias("first"), F.array_join(F.sort_array(F.collect_list(name)), ", ").alias("detections"))
    damped = F.when(F.col("raw") <= 75, F.col("raw")).otherwise(F.least(F.lit(99), F.round(75 + 24 * (1 - F.exp(-(F.col("raw") - 75) / 50.0)))))
    out = out.filter(F.col("raw") > 0).withColumn("score", damped.cast("int"))
    return out.withColumn("severity", E.risk_severity("score"))


def without_orphans(findings: DataFrame) -> DataFrame:
    """Host risk rows go where the host has no other finding left (JOIN-19)."""
    hosts = findings.filter(~F.col("type").isin(list(V.ROLLUPS))).select("src_ip").distinct()
    risk = findings.filter(F.col("type") == "Host Risk Score")
    return findings.filter(F.col("type") != "Host Risk Score").unionByName(risk.join(hosts, "src_ip", "left_semi"))
