"""Beacons (DET-1..5, 19, 34): regular contact of one key, profiled over all records, then gated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.config import DEFAULT, Config
from packetloom.functions import exprs as E
from packetloom.operators import detect, matching, order, shape, spectrum, stats
from packetloom.sources.scratch import written


def profile(df: DataFrame, keys: Sequence[str] = ("sensor", "src", "dst"), ts: str = "ts", bytes_: str = "orig_bytes", least: int = 4, cfg: Config = DEFAULT, gathered: int = 10_000) -> DataFrame:
    """All keys with enough records, with every sub-score over all their records; ``keys`` begins with the sensor.

    Keys of up to ``gathered`` records lie in a row each; of larger ones nothing is gathered or sorted as a whole
    (``order``), so no key outgrows a row. Figures don't depend on the way.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(ts).alias("_ts"), F.col(bytes_).cast("double").alias("_bytes"))
    real = F.when(F.col("_ts") > 0, F.col("_ts"))
    counted = written(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(real).alias("win_min"), F.max(real).alias("win_max")), "counted")
    windows = written(counted.groupBy(keys[0]).agg(F.min("win_min").alias("win_min"), F.max("win_max").alias("win_max")).filter("win_min IS NOT NULL"), "windows")
    windows = windows.withColumn("begin", stats.begin(cfg))
    busy = written(counted.filter(F.col("n") > gathered).select(*keys), "busy")
    rows = rows.dropna(subset=keys)
    if busy.isEmpty():
        out = shape.shaped(_series(_whole(rows, keys), keys, least).join(windows, keys[0]))
    else:
        few, many = rows.join(busy, keys, "left_anti"), rows.join(busy, keys, "left_semi")
        out = shape.shaped(_series(_whole(few, keys), keys, least).join(windows, keys[0])).unionByName(_large(many, windows, keys, least))
    out = out.withColumn("dur_score", stats.persistence(cfg))
    out = out.select(
        *keys,
        "n",
        "first",
        "last",
        "mean_iv",
        "median_iv",
        (F.col("sd_iv") / F.col("mean_iv")).alias("cv"),
        F.round("_raw", 3).alias("ts_raw"),
        F.col("_mm").alias("ts_mm"),
        F.when(F.col("gaps") >= 6, stats.concentration(F.col("counts"), F.col("gaps"))).otherwise(0.0).alias("ts_ent"),
        F.round("_ds", 3).alias("ds_score"),
        "hist_score",
        "dur_score",
    )
    out = out.withColumn("ts_score", F.greatest("ts_raw", "ts_mm", "ts_ent"))
    return out.withColumn("conf", stats.confidence(F.col("n"), least, cfg))


def _whole(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of keys that fit into a task, with the interval before each and their hour: dealt out by key once, for all that follows."""
    gap = F.col("_ts") - F.lag("_ts").over(Window.partitionBy(*keys).orderBy("_ts"))
    return rows.withColumns({"iv": F.when(gap > 0, gap), "_hour": F.floor(F.col("_ts") / 3600)})


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("_bucket", F.when(F.col("iv").isNotNull(), stats._bucket(F.col("iv"))))


def _gaps() -> list[Column]:
    """Additive figures of a key's intervals: their number, mean, deviation and logarithmic buckets."""
    buckets = [F.count_if(F.col("_bucket") == b).cast("int") for b in range(stats.BUCKETS)]
    return [F.count("iv").alias("gaps"), F.avg("iv").alias("mean_iv"), F.stddev_pop("iv").alias("sd_iv"), F.array(*buckets).alias("counts")]


def _series(rows: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """One row per key with at least three intervals: figures over all of them, and the values that the order statistics are over."""
    out = _bucketed(rows).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.min("_ts").alias("first"),
        F.max("_ts").alias("last"),
        F.collect_list(F.struct(F.col("_hour").alias("hour"), F.lit(1).cast("long").alias("n"))).alias("hours"),
        F.collect_list(F.when(F.col("iv").isNotNull(), F.struct("iv", "_bucket"))).alias("ivs"),
        F.collect_list(F.when(F.col("_bytes") > 0, F.col("_bytes"))).alias("sizes"),
        *_gaps(),
    )
    return out.filter((F.col("n") >= least) & (F.col("gaps") >= 3))


def _large(rows: DataFrame, windows: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """What ``shape.shaped`` makes of ``_series``, for keys of any size: records are dealt out by key and block of time."""
    spans = written(_spans(rows, keys, least), "busy-rows")
    hours = stats.hourly(spans, keys, "_ts").groupBy(*keys).agg(F.collect_list(F.struct("hour", "n")).alias("hours"))
    none = {"ivs": F.array().cast("array<struct<iv: double, _bucket: int>>"), "sizes": F.array().cast("array<double>")}
    figures = _bucketed(spans).groupBy(*keys).agg(F.count("*").alias("n"), F.min("_ts").alias("first"), F.max("_ts").alias("last"), *_gaps()).filter("gaps >= 3")
    rhythms = shape.shaped(figures.withColumns(none).join(hours, keys).join(windows, keys[0])).drop("median_iv", "_raw", "_mm", "_ds")
    return rhythms.join(_refined(spans, keys).withColumnRenamed("_median", "median_iv"), keys)


def exact(profiled: DataFrame, df: DataFrame, keys: Sequence[str] = ("sensor", "src", "dst"), ts: str = "ts", bytes_: str = "orig_bytes", least: int = 4, cfg: Config = DEFAULT, gathered: int = 10_000) -> DataFrame:
    """A profile with the order statistics of its busy keys, those over ``cfg.series_sample`` records, taken anew from all their records (STAT-2, 3, 13).

    ``profile`` has them already: this is for profiles that come from elsewhere, as from a stream. Keys with up to
    ``gathered`` records are sorted in a row, in one pass for all figures; of larger ones nothing is gathered or
    sorted (``order``), whatever their size.
    """
    keys, profiled = list(keys), written(profiled, "profiled")
    busy = written(profiled.filter(F.col("n") > cfg.series_sample).select(*keys, "n"), "busy")
    if busy.isEmpty():
        return profiled
    rows, fits = df.select(*keys, F.col(ts).alias("_ts"), F.col(bytes_).cast("double").alias("_bytes")), F.col("n") <= gathered
    held = shape.shaped(_series(_whole(rows.join(busy.filter(fits).select(*keys), keys, "left_semi"), keys), keys, least).drop("hours"))
    again = held.select(*keys, F.col("median_iv").alias("_median"), F.round("_raw", 3).alias("_raw"), F.round("_ds", 3).alias("_ds"), "_mm")
    large = busy.filter(~fits).select(*keys)
    if not large.isEmpty():
        again = again.unionByName(_refined(written(_spans(rows.join(large, keys, "left_semi"), keys, least), "busy-rows"), keys))
    out = profiled.join(again, keys, "left")
    was = F.col("n") > cfg.series_sample
    out = out.withColumns({
        "median_iv": F.when(was, F.col("_median")).otherwise(F.col("median_iv")), "ts_raw": F.when(was, F.col("_raw")).otherwise(F.col("ts_raw")),
        "ts_mm": F.when(was, F.col("_mm")).otherwise(F.col("ts_mm")), "ds_score": F.when(was, F.coalesce("_ds", F.lit(0.0))).otherwise(F.col("ds_score")),
    })
    return out.withColumn("ts_score", F.greatest("ts_raw", "ts_mm", "ts_ent")).select(*profiled.columns)


def _spans(rows: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    return stats.blocked(rows, keys, "_ts", least).select(*keys, "_ts", "iv", F.when(F.col("_bytes") > 0, F.col("_bytes")).alias("_bytes"))


def _refined(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The order statistics of keys of any size, from their intervals and sizes: those of all values and of each mode in the same rounds."""
    keys = list(keys)
    held = _bucketed(rows).join(order.modes(rows, keys, "iv"), [*keys, "_bucket"], "left")
    what = [("iv", F.col("iv")), ("bytes", F.col("_bytes")), ("mode", F.when(F.col("_mode").isNotNull(), F.col("iv")))]
    stacked = F.inline(F.array(*(F.struct(F.lit(name).alias("_what"), F.when(F.lit(name) == "mode", F.col("_mode")).alias("_mode"), v.alias("_v")) for name, v in what)))
    stacked = held.select(*keys, stacked).filter("_v IS NOT NULL").withColumn("_mode", F.coalesce("_mode", F.lit(0)))
    each = order.spread(written(stacked, "stacked"), [*keys, "_what", "_mode"], "_v")
    one = lambda name, value: F.max(F.when(F.col("_what") == name, value))
    return each.groupBy(*keys).agg(
        one("iv", F.col("q2")).alias("_median"),
        one("iv", order.regularity(1.0)).alias("_raw"),
        F.coalesce(one("bytes", F.when(F.col("n") >= 3, order.regularity(0.0))), F.lit(0.0)).alias("_ds"),
        order.tight(F.col("_what") == "mode").alias("_mm"),
    )


def annotated(profiled: DataFrame, df: DataFrame, keys: Sequence[str] = ("sensor", "src", "dst"), ts: str = "ts", cfg: Config = DEFAULT) -> DataFrame:
    """``spectral_rescued`` and ``spectral_period`` of the keys with weak timing (STAT-11 in DET-1): a hint that doesn't lift the score.

    ``spectral_blocked``: the only strong peak was implausible.
    """
    keys, profiled = list(keys), written(profiled, "profiled")
    weak = profiled.filter((F.col("ts_score") < cfg.spectral_rescue) & (F.col("n") >= cfg.spectral_min_observations))
    found = spectrum.periodicity(df, keys, ts, cfg=cfg, gated=weak).select(*keys, "period", "spectral_score", "dominant_period")
    out = profiled.join(found, keys, "left")
    rescued = F.coalesce(F.col("spectral_score") > F.col("ts_score"), F.lit(False))
    out = out.withColumns({"spectral_rescued": rescued, "spectral_period": F.when(rescued, F.col("period"))})
    return out.withColumn("spectral_blocked", ~F.col("spectral_rescued") & F.col("dominant_period").isNotNull()).drop("period", "spectral_score", "dominant_period")


def scored(profiled: DataFrame, prevalence: DataFrame | None = None, boost: bool = True) -> DataFrame:
    """``score`` and ``unboosted``, with the destination's prevalence where it is given; without boost it only damps."""
    if prevalence is None:
        profiled = profiled.withColumn("prevalence_mod", F.lit(1.0))
    else:
        # Written, its size is known: dealt out by so few keys, the profiles would lie in few tasks.
        prevalence = written(prevalence.select("sensor", "dst", "prevalence_mod"), "prevalence")
        profiled = profiled.join(prevalence, ["sensor", "dst"], "left").fillna({"prevalence_mod": 1.0})
        if not boost:
            profiled = profiled.withColumn("prevalence_mod", F.least("prevalence_mod", F.lit(1.0)))
    base = 100 * (F.col("ts_score") * 0.25 + F.col("ds_score") * 0.25 + F.col("hist_score") * 0.25 + F.col("dur_score") * 0.25) * F.col("conf")
    return profiled.withColumns({"score": E.clamp(base * F.col("prevalence_mod"), 1, 100), "unboosted": E.clamp(base, 1, 100)})


def ports(df: DataFrame, keys: Sequence[str] = ("sensor", "src", "dst"), port: str = "port") -> DataFrame:
    """Per key its modal port (ties: the lower), how many ports, the top share, and whether it hops."""
    w = Window.partitionBy(*keys).orderBy(F.desc("c"), port)
    counted = df.groupBy(*keys, port).agg(F.count("*").alias("c")).withColumn("r", F.row_number().over(w))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("r", F.col(port).alias("p"), "c"))), lambda x: F.concat(x["p"].cast("string"), F.lit("x"), x["c"].cast("string")))
    out = counted.groupBy(*keys).agg(
        F.min(F.when(F.col("r") == 1, F.col(port))).alias("modal_port"),
        F.count("*").alias("n_ports"),
        (F.max("c") / F.sum("c")).alias("top_share"),
        listed.alias("listed"),
    )
    hops = (F.col("n_ports") >= 5) & (F.col("top_share") < 0.5)
    return out.withColumn("hops", hops).withColumn("co_traffic", F.array_join(F.slice("listed", 2, 1_000_000), ", ")).drop("listed")


def findings(scored_: DataFrame, ports_: DataFrame | None = None, kind: str = "Beacon", least_score: int | None = None, severity: Column | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """Rows that pass the gate, as findings with their text."""
    gated = scored_.filter(F.col("score") >= (cfg.beacon_min_score if least_score is None else least_score))
    kind_ = F.lit(kind)
    if ports_ is not None:
        gated = gated.join(ports_, ["sensor", "src", "dst"], "left")
        kind_ = F.when(F.col("hops"), "Port-Hopping Beacon").otherwise(kind)
    detail = F.format_string(
        "Connections: %d | Mean interval: %.1fs | CV: %.2f | ts=%.2f ds=%.2f hist=%.2f dur=%.2f conf=%.2f",
        *(F.col(c) for c in ("n", "mean_iv", "cv", "ts_score", "ds_score", "hist_score", "dur_score", "conf")),
    )
    sev = E.beacon_severity("score") if severity is None else severity
    return gated.withColumns({"type": kind_, "severity": sev, "detail": detail, "src_ip": F.col("src"), "timestamp": E.when_text("first")})


def without_strobes(profiled: DataFrame, strobe_keys: DataFrame) -> DataFrame:
    """A pair that the strobe rule owns is not a beacon (JOIN-17)."""
    return profiled.join(strobe_keys.select("sensor", "src", "dst"), ["sensor", "src", "dst"], "left_anti")


def with_tls(beacons: DataFrame, conn: DataFrame, ssl: DataFrame) -> DataFrame:
    """First non-empty SNI and first JA3 (with its JA4) of all of a beacon's connections in time order (JOIN-1, DET-5)."""
    keys, beacons = ["sensor", "src", "dst"], written(beacons, "beacons")
    last = Window.partitionBy("uid").orderBy(F.desc("ts"))
    # Not by a rank, which Spark would limit before the shuffle as well: few uids occur twice, so that sorts all rows once more for nothing.
    one = ssl.withColumn("_later", F.lag(F.lit(1)).over(last)).filter("_later IS NULL").select("uid", "server_name", "ja3", *(["ja4"] if "ja4" in ssl.columns else []))
    if "ja4" not in one.columns:
        one = one.withColumn("ja4", F.lit(None).cast("string"))
    joined = conn.join(beacons.select(*keys), keys, "left_semi").join(one, "uid")
    early = F.struct(F.col("ts").isNull(), "ts", "uid")  # connections without a time are the last
    meta = joined.groupBy(*keys).agg(
        F.min_by("server_name", F.when(F.coalesce("server_name", F.lit("")) != "", early)).alias("hostname"),
        F.min_by(F.struct("ja3", "ja4"), F.when(F.coalesce("ja3", F.lit("")) != "", early)).alias("f"),
    )
    out = beacons.join(meta.select(*keys, "hostname", "f.ja3", "f.ja4"), keys, "left")
    if {"score", "unboosted"} <= set(out.columns):
        out = out.withColumn("score", F.when(F.col("hostname").isNotNull(), F.least("score", "unboosted")).otherwise(F.col("score")))
    return out


def channels(conn: DataFrame, ssl: DataFrame, blend: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Connections of one pair split by JA3: channels that score above the pair's blend (DET-4)."""
    keys = ["sensor", "src", "dst"]
    split = conn.select("uid", *keys, "ts", "orig_bytes").join(ssl.filter(F.coalesce("ja3", F.lit("")) != "").select("uid", "ja3").distinct(), "uid")
    split = written(split, "split")  # read several times
    several = split.groupBy(*keys).agg(F.countDistinct("ja3").alias("k")).filter("k >= 2").select(*keys)
    each = scored(profile(split.join(several, keys, "left_semi"), [*keys, "ja3"], cfg=cfg)).withColumnRenamed("ja3", "channel")
    base = blend.filter(F.col("type") == "Beacon").select(*keys, F.col("score").alias("blend_score"))
    return each.join(base, keys).filter((F.col("score") >= cfg.beacon_min_score) & (F.col("score") > F.col("blend_score")))


def http_beacons(http: DataFrame, cfg: Config = DEFAULT, prevalence: DataFrame | None = None) -> DataFrame:
    """HTTP beacons (DET-34): one host's URI asked for at a regular pace; as DET-1, without the lift of rare destinations."""
    keys = ["sensor", "src", "dst", "port", "host", "uri"]
    rows = http.filter(F.coalesce("host", F.lit("")) != "")
    if "orig_bytes" not in rows.columns:
        rows = rows.withColumn("orig_bytes", F.lit(0.0))
    rows = written(rows.select(*keys, "ts", "orig_bytes"), "requests")  # read several times
    found = scored(annotated(profile(rows, keys, least=cfg.http_beacon_min_requests, cfg=cfg), rows, keys, cfg=cfg), prevalence, boost=False)
    found = found.filter(F.col("score") >= cfg.beacon_min_score)
    detail = F.format_string(
        "Requests: %d | Host: %s | URI: %s | Score: ts=%.2f ds=%.2f hist=%.2f dur=%.2f conf=%.2f | ts_layers: raw=%.2f mm=%.2f ent=%.2f",
        *(F.col(c) for c in ("n", "host", "uri", "ts_score", "ds_score", "hist_score", "dur_score", "conf", "ts_raw", "ts_mm", "ts_ent")),
    )
    return found.withColumns({"type": F.lit("HTTP Beacon"), "severity": E.beacon_severity("score"), "src_ip": F.col("src"), "dst_ip": F.col("dst"), "dst_port": F.col("port").cast("string"), "hostname": F.col("host"), "detail": detail, "timestamp": E.when_text("first")})


def dns_beacons(dns: DataFrame, cfg: Config = DEFAULT, allowed: DataFrame | None = None, suffixes: DataFrame | None = None) -> DataFrame:
    """DNS beacons (DET-19): at least ``dns_beacon_min_queries`` answered queries of one domain at a regular pace.

    Content networks and allowed domains are left out; so are domains with as many names as the generated-name
    rule takes (that rule owns them). No lift, no floor.
    """
    keys = ["sensor", "src", "apex"]
    rows = detect.dns_rows(dns, suffixes).filter(F.coalesce("rcode", F.lit("")) != "NXDOMAIN").filter(~E.is_cdn(F.concat(F.lit("."), F.col("apex")))).withColumn("orig_bytes", F.lit(0.0))
    if allowed is not None:
        rows = rows.join(matching.matches(rows, "apex", allowed).select("apex").distinct(), "apex", "left_anti")
    rows = written(rows.select(*keys, "ts", "orig_bytes"), "answered")  # read several times
    profiled = annotated(profile(rows, keys, least=cfg.dns_beacon_min_queries, cfg=cfg), rows, keys, cfg=cfg)
    found = dns_scored(profiled, detect.subdomains(dns, suffixes).select(*keys, "n_subs"), cfg)
    detail = F.format_string(
        "DNS queries: %d | Unique subdomains: %d | Mean interval: %.1fs | CV: %.2f | Score: ts=%.2f conf=%.2f",
        *(F.col(c) for c in ("n", "n_subs", "mean_iv", "cv", "ts_score", "conf")),
    )
    return found.withColumns({"type": F.lit("DNS Beacon"), "src_ip": F.col("src"), "dst_ip": F.col("apex"), "hostname": F.col("apex"), "detail": detail, "timestamp": E.when_text("first")})


def dns_scored(profiled: DataFrame, subs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Timing half, few subdomains a quarter, rhythm and persistence a quarter (DET-19); no lift, no floor."""
    joined = profiled.join(subs, ["sensor", "src", "apex"]).filter(F.col("n_subs") < cfg.unique_subdomain_min)
    few = F.greatest(F.lit(0.0), 1 - F.col("n_subs") / float(max(1, cfg.unique_subdomain_min)))
    base = 100 * (0.5 * F.col("ts_score") + 0.25 * few + 0.25 * (F.col("hist_score") + F.col("dur_score")) / 2) * F.col("conf")
    return joined.withColumn("score", E.clamp(base, 1, 100)).withColumn("severity", F.when(F.col("score") >= 80, "CRITICAL").otherwise("HIGH"))
