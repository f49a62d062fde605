"""Reports over findings (AGG), sorting and paging (ORD, WIN-9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions import exprs as E
from packetloom.functions import values as V
from packetloom.operators import order
from packetloom.operators.listing import Filters, Lists, filtered


def no_rollups(findings: DataFrame) -> DataFrame:
    return findings.filter(~F.col("type").isin(list(V.ROLLUPS)))


def campaigns(findings: DataFrame, least_sources: int = 2) -> DataFrame:
    """Destinations and ports that several sources' findings name, roll-ups included (AGG-1)."""
    named = findings.filter(~F.coalesce("dst_ip", F.lit("")).isin("", "(network)"))
    out = named.groupBy("dst_ip", "dst_port").agg(
        F.countDistinct(F.when(F.col("src_ip") != "", F.col("src_ip"))).alias("sources"), F.array_join(F.sort_array(F.collect_set("type")), ", ").alias("types"), F.max("score").alias("max_score"), F.count("*").alias("n")
    )
    return out.filter(F.col("sources") >= least_sources)


def hosts(findings: DataFrame, internal: Column | None = None) -> DataFrame:
    rows = no_rollups(findings).filter(E.is_private("src_ip") if internal is None else internal)
    return rows.groupBy("src_ip").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("type").isin(list(V.BEACONS))).alias("beacons"),
        F.max("score").alias("max_score"),
        F.min_by("severity", E.severity_rank("severity")).alias("worst"),
        F.array_join(F.sort_array(F.collect_set("type")), ", ").alias("types"),
    )


def status_counts(findings: DataFrame) -> DataFrame:
    is_ = lambda s: F.count_if(F.coalesce("status", F.lit("")) == s)
    flags = [is_("").alias("open"), is_("acknowledged").alias("acknowledged"), is_("escalated").alias("escalated"), is_("dismissed").alias("dismissed")]
    return findings.agg(*flags, F.count_if("ioc_match").alias("ioc"), F.count("*").alias("total"))


def tab_counts(findings: DataFrame) -> DataFrame:
    """Status counts, and how many campaigns and hosts there are (AGG-3); one row."""
    more = campaigns(findings).agg(F.count("*").alias("campaigns")).join(hosts(findings).agg(F.count("*").alias("hosts")))
    return status_counts(findings).join(more)


def facets(findings: DataFrame) -> DataFrame:
    pairs = F.array(F.struct(F.lit("type").alias("facet"), F.col("type").alias("value")), F.struct(F.lit("sensor").alias("facet"), F.col("sensor").alias("value")))
    return findings.select(F.inline(pairs)).filter("value IS NOT NULL").distinct()


def trend(findings: DataFrame, dimension: str = "severity", most_days: int = 3660) -> DataFrame:
    """Counts per day and value, with zeros between the first and the last day (AGG-5); ``family`` is that of the type."""
    rows = no_rollups(findings).withColumn("family", E.trend_family("type"))
    rows = rows.select(F.to_date(F.substring("timestamp", 1, 10)).alias("day"), dimension).filter("day IS NOT NULL")
    counted = rows.groupBy("day", dimension).agg(F.count("*").alias("n"))
    ends = counted.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    if ends.a is None:
        return counted
    days = counted.select(dimension).distinct().withColumn("day", F.explode(F.sequence(F.greatest(F.lit(ends.a), F.date_sub(F.lit(ends.b), most_days)), F.lit(ends.b))))
    return days.join(counted, ["day", dimension], "left").fillna({"n": 0})


def technique_rows(spark) -> DataFrame:
    rows = [(t, i, *V.TECHNIQUES[i]) for t, ids in V.TYPE_TECHNIQUES.items() for i in ids]
    return spark.createDataFrame(rows, "type string, technique string, name string, tactic string")


def coverage(findings: DataFrame) -> DataFrame:
    """Findings per technique, with the types behind them (AGG-6)."""
    counted = findings.groupBy("type").agg(F.count("*").alias("n"))
    return counted.join(technique_rows(findings.sparkSession), "type").groupBy("technique", "name", "tactic").agg(F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_set("type")), ", ").alias("types"))


def unmapped(findings: DataFrame) -> DataFrame:
    return findings.select("type").distinct().join(technique_rows(findings.sparkSession), "type", "left_anti")


def activity(findings: DataFrame, now: str) -> DataFrame:
    """Per type, roll-ups apart: what was detected in the last 7 days, in the 7 before, in all, and whether it fell silent (AGG-7)."""
    at = F.try_to_timestamp("detected_at", F.lit("yyyy-MM-dd HH:mm:ss"))
    end = F.lit(now).cast("timestamp")
    week = F.expr("INTERVAL 7 DAYS")
    last, prior = at >= end - week, (at >= end - week - week) & (at < end - week)
    out = no_rollups(findings).groupBy("type").agg(F.count_if(last).alias("last7"), F.count_if(prior).alias("prior7"), F.count("*").alias("total"))
    return out.withColumn("dropped", (F.col("last7") == 0) & (F.col("prior7") > 0))


def concern(prevalence: DataFrame) -> DataFrame:
    """How much a TLS client's rarity says (AGG-8): few destinations, more so where several hosts share it; a JA3 says less than a JA4."""
    rare, clustered, strong = F.col("dsts") <= 8, F.col("srcs") >= 2, F.col("kind") == "ja4"
    level = F.when(~rare, "none").when(strong & clustered, "critical").when(strong, "high").when(clustered, "medium").otherwise("low")
    reason = (
        F.when(~rare, "Common (browser/SDK shape)")
        .when(strong & clustered, "Rare client, clustered across hosts")
        .when(strong, "Rare client, single host")
        .when(clustered, "Rare, clustered \u2014 JA3 only, collision possible")
        .otherwise("Rare, single host \u2014 JA3 only, lower confidence")
    )
    return prevalence.withColumns({"concern": level, "reason": reason})


def inventory(prevalence: DataFrame, bad: DataFrame, benign: DataFrame | None = None) -> DataFrame:
    """Known-bad TLS clients and those of medium concern or more (AGG-9); rank 0 is the worst.

    ``bad`` (kind, fp, label) counts as critical, whatever is marked benign; ``benign`` (kind, fp) leaves the others out.
    """
    keys = ["kind", "fp"]
    out = concern(prevalence).join(bad.select(*keys, "label").dropDuplicates(keys), keys, "left")
    known = F.col("label").isNotNull()
    if benign is not None:
        out = out.join(benign.select(*keys).distinct().withColumn("_benign", F.lit(True)), keys, "left").filter(known | F.col("_benign").isNull()).drop("_benign")
    out = out.withColumns({"concern": F.when(known, "critical").otherwise(F.col("concern")), "reason": F.when(known, "Known C2 fingerprint").otherwise(F.col("reason"))})
    rank = E.pick(F.col("concern"), {"critical": 0, "high": 1, "medium": 2})
    return out.withColumn("rank", rank).filter("rank IS NOT NULL")


def unseen(findings: DataFrame, since: str) -> DataFrame:
    return findings.agg(F.count_if("is_new").alias("new"), F.count_if((F.col("detected_at") > since) & ~F.col("type").isin(list(V.ROLLUPS))).alias("unseen"))


def census(findings: DataFrame, by: Sequence[str] = ("type", "severity")) -> DataFrame:
    return findings.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("score"), 1).alias("avg_score"))


def timing_layer() -> Column:
    """The timing layer that decides a beacon's timing score."""
    ent, mm, raw = F.col("ts_ent"), F.col("ts_mm"), F.col("ts_raw")
    return F.when((ent > raw) & (ent > mm), "entropy").when(mm > raw, "multimodal").otherwise("raw")


def timing_layers(beacons: DataFrame) -> DataFrame:
    """Which timing layer carried each beacon, against severity and disposition (AGG-14)."""
    is_ = lambda s: F.count_if(F.coalesce("status", F.lit("")) == s)
    said = {"open": "", "acknowledged": "acknowledged", "escalated": "escalated", "dismissed": "dismissed"} if "status" in beacons.columns else {}
    out = beacons.withColumn("layer", timing_layer()).groupBy("layer")
    return out.agg(F.count("*").alias("n"), *(F.count_if(F.col("severity") == s).alias(s.lower()) for s in V.SEVERITIES), *(is_(s).alias(n) for n, s in said.items()))


def periodic_summary(beacons: DataFrame) -> DataFrame:
    """How many beacons carry the periodic hint, and what became of them (AGG-14)."""
    flag = F.coalesce("spectral_rescued", F.lit(False))
    is_ = lambda s: F.count_if(flag & (F.coalesce("status", F.lit("")) == s))
    return beacons.agg(F.count_if(flag).alias("flagged"), is_("escalated").alias("escalated"), is_("acknowledged").alias("acknowledged"), is_("dismissed").alias("dismissed"), F.count("*").alias("total"))


def layer_census(beacons: DataFrame) -> DataFrame:
    """Per timing layer: beacons, mean score, critical and dismissed ones (AGG-15)."""
    rows = beacons.withColumn("layer", timing_layer()).groupBy("layer")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("score"), 1).alias("avg_score"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("status") == "dismissed").alias("dismissed"))


def implausible_periods(findings: DataFrame, share: float = 0.2) -> DataFrame:
    """Findings whose text names a period below a fifth of the median interval: the lower bound was passed (AGG-15)."""
    period = F.regexp_extract("detail", r"period ([0-9.]+)s,", 1).try_cast("double")
    rows = findings.filter(F.contains("detail", F.lit("Spectral signal")) & (F.col("median_interval") > 0)).withColumn("period", period)
    rows = rows.filter((F.col("period") > 0) & (F.col("period") < F.col("median_interval") * share))
    return rows.select("id", "type", "period", "median_interval", (F.col("period") / F.col("median_interval")).alias("ratio"))


def suppressed_peaks(findings: DataFrame) -> DataFrame:
    """Findings with a stronger peak that was set aside, and its text (AGG-15)."""
    peak = F.regexp_extract("detail", r"(\[artifact .*?suppressed\])", 1)
    return findings.withColumn("peak", peak).filter("peak != ''").select("id", "score", "peak")


def blocked_totals(runs: DataFrame, last: int = 10) -> DataFrame:
    """Periodic hints that were blocked entirely, over the last runs (AGG-16): ``runs`` (run_at, spectral_blocked)."""
    recent = runs.orderBy(F.desc("run_at")).limit(last)
    return recent.agg(F.coalesce(F.sum("spectral_blocked"), F.lit(0)).alias("blocked"), F.count("*").alias("runs"))


def beacon_history(history: DataFrame, today: str, days: int = 30) -> DataFrame:
    """The daily figures of the last days, by identity and day (AGG-11)."""
    return history.filter((F.col("day").cast("date") >= F.date_sub(F.lit(today).cast("date"), days)) & (F.col("day").cast("date") <= F.lit(today).cast("date")))


def indicators_per_feed(indicators: DataFrame) -> DataFrame:
    """AGG-12."""
    return indicators.groupBy("feed").agg(F.count("*").alias("n"))


def graph(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hosts with counts and worst severity, and weighted links (AGG-18)."""
    rank = E.severity_rank("severity")
    ends = no_rollups(findings).withColumn("rank", rank)
    nodes = ends.select(F.explode(F.array_distinct(F.array("src_ip", "dst_ip"))).alias("host"), "rank").groupBy("host").agg(F.count("*").alias("n"), F.min("rank").alias("worst"))
    nodes = nodes.withColumn("internal", E.is_private("host"))
    # The external host with the worst severity, the busiest first, is marked if that is high.
    worst = nodes.filter(~F.col("internal") & (F.col("worst") <= 1)).agg(F.min_by("host", F.struct("worst", (-F.col("n")).alias("n"), "host")).alias("_marked"))
    nodes = nodes.join(worst).withColumn("marked", F.coalesce(F.col("host") == F.col("_marked"), F.lit(False))).drop("_marked")
    links = ends.groupBy("src_ip", "dst_ip").agg(F.count("*").alias("n"), F.min("rank").alias("worst"))
    return nodes, links.withColumn("weight", F.least(F.lit(8.0), 1 + F.log2("n")))


def capped(nodes: DataFrame, links: DataFrame, most: int = 200, hint: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The best-connected hosts, a hinted one among them, and the links among these (AGG-19)."""
    degree = links.select(F.col("src_ip").alias("host")).union(links.select("dst_ip")).groupBy("host").agg(F.count("*").alias("degree"))
    hinted = F.col("host") == hint if hint else F.lit(False)
    top = nodes.join(degree, "host", "left").fillna({"degree": 0}).orderBy(hinted.desc(), F.desc("degree"), F.desc("n"), "host").limit(most)
    held = top.select("host")
    return top, links.join(held.withColumnRenamed("host", "src_ip"), "src_ip", "left_semi").join(held.withColumnRenamed("host", "dst_ip"), "dst_ip", "left_semi")


def interval_histogram(df: DataFrame, keys: Sequence[str], value: str = "iv") -> DataFrame:
    """Linear bins of each key's values without the top hundredth (AGG-20); 12 to 40 bins, twice the root of the count.

    The values left are the first 99 % in order. The last of them is found by refined histograms (``order``), so no
    key is sorted in one task; of the values equal to it, as many count as fit.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("v")).filter("v IS NOT NULL")
    kept = F.greatest(F.lit(1), F.floor(F.count("*") * 0.99)).cast("long")
    sizes = rows.groupBy(*keys).agg(F.min("v").alias("low"), kept.alias("kept"))
    tops = order.at_ranks(rows, keys, "v", sizes.select(*keys, F.lit("top").alias("slot"), (F.col("kept") - 1).alias("rank")))
    held = sizes.join(tops.select(*keys, F.col("value").alias("top")), keys)
    bins = F.least(F.lit(40), F.greatest(F.lit(12), F.floor(F.sqrt("kept") * 2))).cast("int")
    width = F.greatest(F.col("top") - F.col("low"), F.lit(0.001)) / bins
    place = F.least(bins - 1, F.greatest(F.lit(0), F.floor((F.col("v") - F.col("low")) / width).cast("int")))
    counted = rows.join(held, keys).filter("v <= top").groupBy(*keys, "kept", bins.alias("bins"), place.alias("bin"), (F.col("v") == F.col("top")).alias("last")).agg(F.count("*").alias("c"))
    below = F.sum(F.when(~F.col("last"), F.col("c")).otherwise(0)).over(Window.partitionBy(*keys))  # 41 rows of a key at most
    fitting = F.when(F.col("last"), F.col("kept") - below).otherwise(F.col("c"))
    return counted.withColumn("c", fitting).groupBy(*keys, "bins", "bin").agg(F.sum("c").alias("n"))


def byte_bins(df: DataFrame, keys: Sequence[str], bins: int = 24) -> DataFrame:
    """Bytes each way in bins over each key's span, and whether a bin is mostly upload (AGG-21)."""
    spans = df.groupBy(*keys).agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    place = F.when(F.col("t1") > F.col("t0"), F.least(F.lit(bins - 1), F.floor((F.col("ts") - F.col("t0")) / (F.col("t1") - F.col("t0")) * bins))).otherwise(0)
    out = df.join(spans, list(keys)).groupBy(*keys, place.cast("int").alias("bin")).agg(F.sum("orig_bytes").alias("sent"), F.sum("resp_bytes").alias("received"))
    return out.withColumn("upload", F.col("sent") > 2 * F.col("received"))


def notable(findings: DataFrame, least: int = 95, skip: Sequence[str] = ("Host Risk Score", "Suspicious File Download", "Off-Hours Transfer"), lists: Lists | None = None) -> DataFrame:
    """What notifications are made of: new rows with a top score that no list hides (AGG-22)."""
    rows = findings.filter(F.col("is_new") & (F.col("score") >= least) & ~F.col("type").isin(list(skip)))
    return rows if lists is None else filtered(rows, Filters(include_dismissed=True), lists).select(rows.columns)


def inventory_counts(inventory_: DataFrame, findings: DataFrame) -> DataFrame:
    """The inventory with the findings that carry each fingerprint, ranked (AGG-9)."""
    pairs = F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("fp")) for c in ("ja3", "ja4") if c in findings.columns))
    n = findings.select(F.inline(pairs)).filter(F.coalesce("fp", F.lit("")) != "").groupBy("kind", "fp").agg(F.count("*").alias("findings"))
    return inventory_.join(n, ["kind", "fp"], "left").fillna({"findings": 0}).orderBy("rank", F.desc("srcs"), F.desc("conns"), "fp")


def ordered(findings: DataFrame, by: str = "score", descending: bool = True) -> DataFrame:
    key = E.severity_rank("severity") if by == "severity" else F.col(by)
    return findings.orderBy(key.desc() if descending else key.asc(), "id")


def page(findings: DataFrame, by: str = "score", descending: bool = True, offset: int = 0, limit: int = 1000, total: bool = False) -> DataFrame:
    """A page of the sorted list, on request with ``total``, the count of all rows (ORD-2)."""
    rows = ordered(findings, by, descending).offset(offset).limit(min(limit, 50_000))
    return rows.join(findings.agg(F.count("*").alias("total"))) if total else rows


def position(findings: DataFrame, id_: int, by: str = "score") -> int | None:
    """How many rows come before one in the sorted list, counted without sorting (WIN-9)."""
    own = findings.filter(F.col("id") == id_).select(by).first()
    if own is None:
        return None
    ahead = (F.col(by) > own[0]) | ((F.col(by) == own[0]) & (F.col("id") < id_))
    return findings.filter(ahead).count() + 1


def report_pack(findings: DataFrame) -> dict[str, DataFrame]:
    """The named tables of the report pack (SNK-6)."""
    is_ = lambda s: findings.filter(F.coalesce("status", F.lit("")) == s)
    return {"open": is_(""), "acknowledged": is_("acknowledged"), "escalated": is_("escalated"), "ioc_hits": findings.filter("ioc_match"), "campaigns": campaigns(findings), "hosts": hosts(findings)}
