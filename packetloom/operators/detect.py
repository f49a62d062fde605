"""Detections on records and simple groups (DET-6..33). The first record per key is the earliest by (ts, uid)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.config import DEFAULT, Config
from packetloom.functions import exprs as E
from packetloom.functions import values as V
from packetloom.operators import matching, names
from packetloom.sources import logs

FINDING = ("type", "severity", "score", "sensor", "src_ip", "dst_ip", "dst_port", "detail", "timestamp")


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts", "uid")) -> DataFrame:
    """The first record of each key (WIN-2)."""
    held = [c for c in order if c in df.columns]
    rest = [c for c in df.columns if c not in held and c not in keys]
    w = Window.partitionBy(*keys).orderBy(*held, *(F.col(c).cast("string") for c in rest))
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def finding(df: DataFrame, kind: Column | str, severity: Column | str, score: Column | int, detail: Column, src: str = "src", dst: str = "dst", port: str | None = "port", ts: str = "ts") -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    cols = {
        "type": lit(kind),
        "severity": lit(severity),
        "score": lit(score).cast("int"),
        "sensor": F.col("sensor") if "sensor" in df.columns else F.lit(None).cast("string"),
        "src_ip": F.col(src),
        "dst_ip": F.col(dst),
        "dst_port": F.col(port).cast("string") if port else F.lit(None).cast("string"),
        "detail": detail,
        "timestamp": E.when_text(ts),
    }
    return df.select(*(c.alias(n) for n, c in cols.items()))


def external(df: DataFrame) -> DataFrame:
    return df.filter(~E.is_private("dst"))


def egress(df: DataFrame) -> DataFrame:
    """External destinations that are no local infrastructure (PRED-19)."""
    return external(df).filter(~E.is_local_infra("dst"))


def strobe_keys(conn: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    out = egress(conn).groupBy("sensor", "src", "dst").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    span = F.col("last") - F.col("first")
    return out.filter((F.col("n") >= cfg.strobe_min_connections) & ((span <= 0) | (F.col("n") / span >= cfg.strobe_min_rate)))


def strobe(conn: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    out = strobe_keys(conn, cfg)
    detail = F.format_string("Connection count: %d", "n")
    return finding(out, "Strobe", "HIGH", E.clamp(50 + F.log10("n") * 15, 1, 88), detail, port=None, ts="first")


def exfiltration(conn: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    out = egress(conn).groupBy("sensor", "src", "dst").agg(F.sum("orig_bytes").alias("orig"), F.sum("resp_bytes").alias("resp"), F.min("ts").alias("first"))
    mb = F.col("orig") / 1e6
    ratio = F.when(F.col("resp") > 0, F.col("orig") / F.col("resp")).when(F.col("orig") > 0, cfg.exfil_ratio + 1).otherwise(0.0)
    out = out.withColumns({"mb": mb, "ratio": ratio}).filter((F.col("mb") >= cfg.exfil_min_mb) & (F.col("ratio") >= cfg.exfil_ratio))
    detail = F.format_string("Outbound: %.2f MB | Ratio out/in: %.1f", "mb", "ratio")
    return finding(out, "Data Exfiltration", "CRITICAL", E.clamp(55 + F.log10(F.col("mb") + 1) * 12, 1, 92), detail, port=None, ts="first")


def off_hours(conn: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    out = egress(conn).filter(E.off_hours("ts", cfg)).groupBy("sensor", "src", "dst").agg(F.sum("orig_bytes").alias("orig"), F.min("ts").alias("first"))
    out = out.withColumn("mb", F.col("orig") / 1e6).filter(F.col("mb") >= cfg.off_hours_min_mb)
    detail = F.format_string("%.2f MB outbound off hours", "mb")
    return finding(out, "Off-Hours Transfer", "MEDIUM", E.clamp(45 + F.log10(F.col("mb") + 1) * 12, 1, 78), detail, port=None, ts="first")


def long_connection(conn: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    out = conn.withColumn("hours", F.col("duration") / 3600).filter(F.col("hours") >= cfg.long_conn_min_hours)
    sev = F.when(F.col("hours") > 24, "HIGH").otherwise("MEDIUM")
    return finding(out, "Long Connection", sev, E.clamp(50 + F.col("hours") / 8, 1, 95), F.format_string("Duration: %.2f hours", "hours"))


def lateral(conn: DataFrame) -> DataFrame:
    label = E.first_of(E.services("service"), V.LATERAL_SERVICES)
    rows = conn.filter(E.is_private("src") & E.is_private("dst")).withColumn("label", label)
    rows = rows.filter(F.col("port").isin(list(V.LATERAL_PORTS)) | F.col("label").isNotNull())
    by_port = F.concat(F.lit("Internal to internal on port "), F.col("port").cast("string"))
    by_label = F.concat(F.lit("Internal to internal "), E.pick(F.col("label"), V.LATERAL_SERVICES), F.lit(" outside its usual port"))
    detail = F.when(F.col("port").isin(list(V.LATERAL_PORTS)), by_port).otherwise(by_label)
    return finding(first_per(rows, ["sensor", "src", "dst", "port"]), "Lateral Movement", "HIGH", 78, detail)


def c2_port(conn: DataFrame) -> DataFrame:
    rows = egress(conn).withColumn("label", E.pick(F.col("port"), V.C2_PORTS)).filter(F.col("label").isNotNull())
    rows = first_per(rows, ["sensor", "src", "dst", "port"]).withColumn("usual", E.expected_on_port("service", "port"))
    detail = F.concat(F.lit("Port "), F.col("port").cast("string"), F.lit(" - "), F.col("label"))
    return finding(rows, "C2 Port", F.when(F.col("usual"), "MEDIUM").otherwise("HIGH"), F.when(F.col("usual"), 50).otherwise(75), detail)


def unexpected_port(conn: DataFrame) -> DataFrame:
    rows = egress(conn).filter(E.unexpected_port("service", "port"))
    rows = first_per(rows, ["sensor", "src", "dst", "port", "service"])
    detail = F.concat(F.col("service"), F.lit(" on port "), F.col("port").cast("string"))
    return finding(rows, "Protocol on Unexpected Port", "HIGH", F.when(F.col("port").isin(list(V.C2_PORTS)), 75).otherwise(70), detail)


def service_egress(conn: DataFrame, names: dict[str, str], kind: str) -> DataFrame:
    """The first label of the named services, from an internal host to an external one."""
    rows = egress(conn).filter(E.is_private("src")).withColumn("label", E.first_of(E.services("service"), names)).filter(F.col("label").isNotNull())
    rows = first_per(rows, ["sensor", "src", "dst", "port", "label"])
    ssh = (F.col("label") == "ssh") & (F.lit(kind) == "Admin Protocol Egress")
    detail = F.concat(E.pick(F.col("label"), names), F.lit(" to a public destination on port "), F.col("port").cast("string"))
    return finding(rows, kind, F.when(ssh, "MEDIUM").otherwise("HIGH"), F.when(ssh, 50).otherwise(72), detail)


def admin_egress(conn: DataFrame) -> DataFrame:
    return service_egress(conn, V.ADMIN_SERVICES, "Admin Protocol Egress")


def database_egress(conn: DataFrame) -> DataFrame:
    return service_egress(conn, V.DATABASE_SERVICES, "Database Protocol Egress")


# DNS


def dns_rows(dns: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Queries without local multicast names, with their registrable domain and subdomain.

    ``suffixes`` (``names.suffix_rules``) are the public suffixes; without them a short built-in list counts.
    """
    out = dns.filter(F.col("query").isNotNull() & ~E.is_mdns("query")).withColumn("query", F.lower("query"))
    out = out.withColumn("apex", E.apex("query")) if suffixes is None else names.with_apex(out, suffixes)
    return out.withColumn("sub", E.subdomain("query", "apex"))


def suspicious_tld(dns: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    rows = dns_rows(dns, suffixes).withColumn("tld", F.element_at(F.split("query", r"\."), -1)).filter(F.col("tld").isin(list(V.SUSPICIOUS_TLDS)))
    return finding(first_per(rows, ["src", "apex"], ("ts", "query")), "Suspicious TLD", "MEDIUM", 52, F.concat(F.lit("TLD ."), F.col("tld")), dst="apex")


def tunneling(dns: DataFrame, cfg: Config = DEFAULT, suffixes: DataFrame | None = None) -> DataFrame:
    label = F.split("query", r"\.")[0]
    rows = dns_rows(dns, suffixes).withColumn("label", label).withColumn("len", F.length("label")).withColumn("ent", E.entropy("label"))
    depth = F.length("query") - F.length(F.replace(F.col("query"), F.lit("."), F.lit("")))
    long = F.col("len") >= cfg.tunnel_label_len
    dense = (F.col("ent") >= cfg.tunnel_entropy) & (F.col("len") >= cfg.tunnel_entropy_min_len)
    deep = depth >= cfg.tunnel_min_depth
    reasons = F.array_compact(F.array(F.when(long, F.lit("long label")), F.when(dense, F.lit("high entropy")), F.when(deep, F.lit("deep nesting"))))
    rows = rows.withColumn("reasons", F.array_join(reasons, ", ")).filter(long | dense | deep)
    rows = first_per(rows, ["src", "apex"], ("ts", "query"))
    return finding(rows, "DNS Tunneling", "HIGH", E.clamp(F.least(55 + F.col("ent") * 6, F.lit(88.0)), 1, 95), F.col("reasons"), dst="apex")


def nxdomain_flood(dns: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    rows = dns.filter((F.col("rcode") == "NXDOMAIN") & ~E.is_mdns("query")).groupBy("sensor", "src").agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    rows = rows.filter(F.col("n") >= cfg.nxdomain_threshold).withColumn("dst", F.lit("(network)")).withColumn("port", F.lit(53))
    return finding(rows, "DNS NXDOMAIN Flood", "HIGH", E.clamp(45 + F.log10("n") * 15, 1, 85), F.format_string("NXDOMAIN responses: %d", "n"), ts="first")


def subdomains(dns: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Distinct subdomains per (sensor, src, apex)."""
    return dns_rows(dns, suffixes).groupBy("sensor", "src", "apex").agg(F.countDistinct("sub").alias("n_subs"), F.count("*").alias("queries"), F.min("ts").alias("first"))


def subdomain_dga(dns: DataFrame, sample: int = 200, cfg: Config = DEFAULT, suffixes: DataFrame | None = None) -> DataFrame:
    """Many subdomains; the mean entropy is over the first ``sample`` in sort order."""
    keys = ["sensor", "src", "apex"]
    subs = dns_rows(dns, suffixes).filter(F.col("sub").isNotNull()).groupBy(*keys, "sub").agg(F.min("ts").alias("first"))
    counted = subs.groupBy(*keys).agg(F.count("*").alias("n"), F.min("first").alias("first")).filter(F.col("n") >= cfg.unique_subdomain_min)
    # Names are ranked and measured only where there are many.
    ranked = subs.select(*keys, "sub").join(counted.select(*keys), keys, "left_semi").withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("sub")))
    measured = ranked.filter(F.col("r") <= sample).groupBy(*keys).agg(F.avg(E.entropy("sub")).alias("ent"))
    out = counted.join(measured, keys).withColumn("port", F.lit(53))
    sev = F.when(F.col("ent") > 3.0, "HIGH").otherwise("MEDIUM")
    return finding(out, "DNS Subdomain DGA", sev, E.clamp(F.least(55 + F.col("ent") * 6, F.lit(90.0)), 1, 95), F.format_string("Unique subdomains: %d", "n"), dst="apex", ts="first")


def resolvers(dns: DataFrame, cap: int = 512, suffixes: DataFrame | None = None) -> DataFrame:
    """Queries and domains of each (sensor, source, resolver); domains count up to ``cap``, ``overflow`` says that there are more (DET-20)."""
    out = dns_rows(dns, suffixes).groupBy("sensor", "src", "resolver").agg(F.count("*").alias("queries"), F.countDistinct("apex").alias("apexes"))
    return out.withColumns({"apexes": F.least("apexes", F.lit(cap)), "overflow": F.col("apexes") > cap})


def resolved(dns: DataFrame, most: int = 8, suffixes: DataFrame | None = None) -> DataFrame:
    """The first addresses, in sort order, that a source's names of a domain resolved to.

    Distinct addresses are ranked and cut before any are gathered.
    """
    keys = ["sensor", "src", "apex"]
    rows = dns_rows(dns, suffixes).select(*keys, F.explode(F.split("answers", r",\s*")).alias("answer")).filter(E.is_ip("answer")).distinct()
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("answer"))).filter(F.col("_r") <= most)
    return first.groupBy(*keys).agg(F.array_join(F.sort_array(F.collect_list("answer")), ",").alias("resolved"))


# TLS and certificates


def fingerprint_list(builtin: dict[str, str], operator: DataFrame | None, spark) -> DataFrame:
    """(fp, label): the built-in label wins over the operator's (SET-3)."""
    rows = spark.createDataFrame([(k, v, 0) for k, v in builtin.items()], "fp string, label string, prio int")
    if operator is not None:
        rows = rows.unionByName(operator.select(F.lower("fp").alias("fp"), F.lit("Operator IOC").alias("label"), F.lit(1).alias("prio")))
    return rows.groupBy("fp").agg(F.min_by("label", "prio").alias("label"))


def malicious_fingerprint(ssl: DataFrame, column: str, listed: DataFrame) -> DataFrame:
    rows = ssl.withColumn("fp", F.lower(column)).join(listed, "fp")
    detail = F.concat(F.lit(f"{column.upper()}: "), F.col("fp"), F.lit(" - "), F.col("label"))
    return finding(first_per(rows, ["src", "dst", "fp"]), f"Malicious {column.upper()}", "CRITICAL", 95, detail)


def doh_bypass(ssl: DataFrame) -> DataFrame:
    rows = ssl.filter((F.col("port") == 443) & F.col("dst").isin(list(V.DOH_RESOLVERS)))
    return finding(first_per(rows, ["src", "dst"]), "DoH Bypass", "MEDIUM", 62, F.concat(F.lit("DNS over HTTPS to "), F.col("dst")))


def no_sni(ssl: DataFrame) -> DataFrame:
    rows = first_per(ssl.filter(F.col("established") & (F.coalesce("server_name", F.lit("")) == "")), ["src", "dst", "port"])
    c2 = F.col("port").isin(list(V.C2_PORTS))
    kind = F.when(c2, "SSL No-SNI on C2 Port").otherwise("SSL No-SNI")
    return finding(rows, kind, F.when(c2, "HIGH").otherwise("LOW"), F.when(c2, 82).otherwise(35), F.concat(F.lit("No SNI on port "), F.col("port").cast("string")))


def fingerprint_prevalence(ssl: DataFrame, kinds: Sequence[str] = ("ja3", "ja4")) -> DataFrame:
    """Connections, sources and destinations of each TLS fingerprint (DET-25)."""
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.lower(F.col(k)).alias("fp")) for k in kinds if k in ssl.columns))
    rows = ssl.select("src", "dst", F.inline(pairs)).filter(F.coalesce("fp", F.lit("")) != "")
    return rows.groupBy("kind", "fp").agg(F.count("*").alias("conns"), F.countDistinct("src").alias("srcs"), F.countDistinct("dst").alias("dsts"))


def certificates(x509: DataFrame) -> DataFrame:
    """Self-signed, default subject, too short or too long a validity."""
    subject, issuer = (F.lower(F.coalesce(c, F.lit(""))) for c in ("subject", "issuer"))
    at = lambda c: F.coalesce(F.expr(f"try_cast({c} AS DOUBLE)"), F.expr(f"CAST(try_to_timestamp({c}) AS DOUBLE)"))
    days = (at("not_after") - at("not_before")) / 86400
    default = F.lit(None).cast("string")
    for d in reversed(V.DEFAULT_SUBJECTS):
        default = F.when(F.contains(subject, F.lit(d)), d).otherwise(default)
    reasons = F.array_compact(
        F.array(
            F.when((subject != "") & (subject == issuer), F.lit("self-signed")),
            F.when(default.isNotNull(), F.concat(F.lit("default subject "), default)),
            F.when(days < 2, F.lit("short validity")).when(days > 3650, F.lit("validity > 10 years")),
        )
    )
    rows = x509.filter((subject != "") | (issuer != "")).withColumn("reasons", F.array_join(reasons, ", ")).filter("reasons != ''")
    rows = first_per(rows, ["subject", "issuer"]).withColumn("src", F.lit("(cert)"))
    return finding(rows, "Suspicious Certificate", "MEDIUM", 58, F.col("reasons"), dst="subject", port=None)


def notices(notice: DataFrame) -> DataFrame:
    rows = first_per(notice.filter(F.coalesce("note", F.lit("")) != ""), ["src", "dst", "note"])
    loud = F.lower("note").rlike("attack|scan|brute|sensitive")
    said = F.when(F.coalesce("msg", F.lit("")).isin("", "-"), F.lit("")).otherwise(F.concat(F.lit(" | "), E.truncated("msg")))
    return finding(rows, "Zeek Notice", F.when(loud, "CRITICAL").otherwise("HIGH"), F.when(loud, 92).otherwise(68), F.concat(F.lit("Notice: "), F.col("note"), said), port=None)


# Files and HTTP


def _suspicious(mime: Column, name: Column) -> Column:
    by_mime = F.lit(False)
    for m in V.SUSPICIOUS_MIME:
        by_mime = by_mime | F.contains(F.lower(F.coalesce(mime, F.lit(""))), F.lit(m))
    by_name = F.lower(F.coalesce(name, F.lit(""))).rlike("(" + "|".join(x.replace(".", r"\.") for x in V.SUSPICIOUS_EXTENSIONS) + ")$")
    return F.when(by_mime, F.concat(F.lit("MIME: "), F.lower(mime))).when(by_name, F.concat(F.lit("name: "), name))


def file_download(files: DataFrame) -> DataFrame:
    """First per (receiver, name and MIME type): the receiver is the source; records without file hosts are those of the connection's ends (DET-28)."""
    rows = logs.file_ends(files).withColumnRenamed("rx", "src").withColumnRenamed("tx", "dst")
    rows = rows.withColumn("reason", _suspicious(F.col("mime_type"), F.col("filename"))).filter(F.col("reason").isNotNull() & F.col("dst").isNotNull())
    rows = rows.withColumn("what", F.concat(F.coalesce("filename", F.lit("")), F.lower(F.coalesce("mime_type", F.lit("")))))
    return finding(first_per(rows, ["src", "what"], ("ts", "dst")), "Suspicious File Download", "HIGH", 72, F.col("reason"), port=None)


def http_download(http: DataFrame) -> DataFrame:
    mime = F.col("resp_mime_types") if "resp_mime_types" in http.columns else F.lit(None).cast("string")
    rows = http.withColumn("reason", _suspicious(mime, F.col("uri"))).filter(F.col("reason").isNotNull())
    return finding(first_per(rows, ["src", "uri"], ("ts", "dst")), "Suspicious File Download", "HIGH", 72, F.col("reason"))


def agents(http: DataFrame) -> DataFrame:
    ua = F.lower(F.coalesce("user_agent", F.lit("")))
    pattern = F.lit(None).cast("string")
    for p in reversed(V.SUSPICIOUS_AGENTS):
        pattern = F.when(F.contains(ua, F.lit(p)), p).otherwise(pattern)
    rows = first_per(http.withColumn("pattern", pattern).filter(F.col("pattern").isNotNull()), ["src", "pattern"])
    return finding(rows, "Suspicious UA", "LOW", 30, F.concat(F.lit("Agent: "), F.col("pattern")))


def uri_checks(http: DataFrame) -> DataFrame:
    """The checksum rule first, then the ordered patterns; first record per (src, dst, uri)."""
    label = F.lit(None).cast("string")
    for pattern, name in reversed(V.C2_URIS):
        label = F.when(F.col("uri").rlike(pattern), name).otherwise(label)
    rows = http.filter(F.octet_length("uri") > 1).withColumn("sum", E.checksum8("uri")).withColumn("label", label)
    hit = F.col("sum").isin(92, 93)
    rows = first_per(rows.filter(hit | F.col("label").isNotNull()), ["src", "dst", "uri"])
    kind = F.when(hit, "Cobalt Strike URI").otherwise("C2 URI Pattern")
    detail = F.when(hit, F.concat(F.lit("Checksum="), F.col("sum").cast("string"))).otherwise(F.col("label"))
    return finding(rows, kind, "CRITICAL", F.when(hit, 93).otherwise(91), detail)


def fronting(http: DataFrame, ssl: DataFrame) -> DataFrame:
    """The HTTP host differs from the TLS name of the same connection (JOIN-2, DET-33)."""
    named = ssl.groupBy("uid").agg(F.max_by("server_name", "ts").alias("server_name")).filter(F.coalesce("server_name", F.lit("")) != "")
    rows = http.filter(F.coalesce("host", F.lit("")) != "").join(named, "uid").filter(F.lower(E.host_without_port("host")) != F.lower(E.host_without_port("server_name")))
    return finding(first_per(rows, ["src", "uid"]), "Domain Fronting", "CRITICAL", 88, F.concat_ws(" / ", "server_name", "host"))


def uri_footprint(http: DataFrame, most: int = 8) -> DataFrame:
    """The top URIs per (sensor, src, dst, port, host), ties by URI (DET-35)."""
    keys = ["sensor", "src", "dst", "port", "host"]
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "uri")
    top = http.groupBy(*keys, "uri").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "uri", F.col("n").alias("count")))), lambda x: F.struct(x["uri"], x["count"])).alias("top_uris"))


#: The log-probability of a pair of letters that the table doesn't have.
UNSEEN = -5.5


def dga(beacons: DataFrame, bigrams: DataFrame, host: str = "hostname", cfg: Config = DEFAULT, allowed: DataFrame | None = None) -> DataFrame:
    """Beacons whose host name looks generated score 15 more and go up one severity, and their text says why (DET-39).

    Only beacon types count. A host on the allowlist (``allowed``: value), by its whole name or by its second-level
    label, is left alone. Thresholds that make no sense turn the rule off. ``bigrams`` (bigram, logp) has at
    most the square of the alphabet's rows; names meet it by a join, so nothing passes through the driver.
    """
    if not (0 <= cfg.dga_entropy <= 8 and -10 <= cfg.dga_bigram < 0):
        return beacons.withColumn("dga", F.lit(False))
    kind = F.col("type").isin(list(V.BEACONS)) if "type" in beacons.columns else F.lit(True)
    # Whether a name looks generated is asked once for each distinct name.
    hosts = beacons.filter(kind).select(F.col(host).alias("_host")).distinct().withColumn("_sld", E.second_level("_host"))
    hosts = hosts.filter(~E.is_ip("_host") & ~E.is_cdn("_host") & (F.length("_sld") >= 7)).withColumn("_ent", E.entropy("_sld")).filter(F.col("_ent") > cfg.dga_entropy)
    pairs = hosts.select("*", F.explode(E.bigrams("_sld")).alias("bigram"))
    found = pairs.join(F.broadcast(bigrams), "bigram", "left").groupBy("_host", "_sld", "_ent").agg((F.sum(F.coalesce("logp", F.lit(UNSEEN))) / F.count("*")).alias("_mean"))
    found = found.filter(F.col("_mean") < cfg.dga_bigram)
    if allowed is not None:
        hit = matching.matches(found.select(F.explode(F.array("_host", "_sld")).alias("_name")), "_name", allowed).select("_name").distinct()
        for name in ("_host", "_sld"):
            found = found.join(hit.withColumnRenamed("_name", name), name, "left_anti")
    rows = beacons.join(found, F.col(host) == F.col("_host"), "left").withColumn("dga", F.coalesce(kind & F.col("_host").isNotNull(), F.lit(False)))
    up = E.pick(F.col("severity"), {"HIGH": "CRITICAL", "MEDIUM": "HIGH", "LOW": "MEDIUM", "CRITICAL": "CRITICAL"})
    on = F.col("dga")
    out = {"score": F.when(on, F.least(F.col("score") + 15, F.lit(99))).otherwise(F.col("score")), "severity": F.when(on, up).otherwise(F.col("severity"))}
    if "detail" in beacons.columns:
        said = F.format_string(" | DGA-suspect destination: %s (SLD=%s, entropy=%.2f, bigram=%.2f)", F.col(host), "_sld", "_ent", "_mean")
        out["detail"] = F.when(on, F.concat(F.coalesce("detail", F.lit("")), said)).otherwise(F.col("detail"))
    return rows.withColumns(out).drop("_host", "_sld", "_ent", "_mean")


def bigram_table(names: DataFrame, text: str = "text") -> DataFrame:
    """(bigram, logp): log10 shares of letter pairs in a column of ordinary words; built, not shipped."""
    words = names.select(F.explode(F.split(F.lower(text), "[^a-z]+")).alias("word")).filter(F.length("word") > 1)
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("bigram"))
    counted = pairs.filter(F.col("bigram").rlike("^[a-z]{2}$")).groupBy("bigram").agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))  # at most 676 rows
    return counted.select("bigram", F.log10(F.col("n") / F.sum("n").over(every)).alias("logp"))
