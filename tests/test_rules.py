"""Rules of roll-ups, corroboration, suffixes, lists and evidence as planted cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from packetloom.config import Config
from packetloom.functions import exprs as E
from packetloom.operators import detect, matching, merge, names, reports, rollups
from packetloom.sources import redact

NOW = "2026-06-08 10:00:00"
FINDING = (
    "id long, type string, score int, sensor string, src_ip string, dst_ip string, timestamp string, dst_port string, severity string, detail string, status string, "
    "analyst string, analyst_note string, detected_at string, is_new boolean, hostname string, uri string, service string"
)


def findings(spark, *rows):
    """rows: (id, type, score, sensor, src, dst, timestamp[, port])."""
    return spark.createDataFrame([(*r[:7], r[7] if len(r) > 7 else "443", "HIGH", "x", "", "", "", NOW, True, "", "", r[8] if len(r) > 8 else "") for r in rows], FINDING)


def beacon(i, src, dst="203.0.113.5", at=NOW, sensor="s1", kind="Beacon", score=80):
    return (i, kind, score, sensor, src, dst, at)


# Correlations


def pairs(rollup):
    return {(r.sensor, r.src_ip, r.dst_ip): (r.n_types, r.score, r.severity, r.timestamp, r.types) for r in rollup.findings.collect()}


def test_two_types_on_a_pair_correlate(spark):
    f = findings(spark, beacon(1, "10.0.0.1", at="2026-06-08 11:00:00"), beacon(2, "10.0.0.1", kind="Strobe", score=70), beacon(3, "10.0.0.1", kind="Malicious JA3", score=95), beacon(4, "10.0.0.2"))
    assert pairs(rollups.correlated(f)) == {("s1", "10.0.0.1", "203.0.113.5"): (3, 99, "CRITICAL", NOW, "Beacon, Malicious JA3, Strobe")}
    assert rollups.correlated(f, least_types=1).findings.count() == 0 and rollups.correlated(f, least_types=4).findings.count() == 0


@pytest.mark.parametrize("kind", ["Long Connection", "Zeek Notice", "Host Risk Score", "Correlated Activity", "Multi-Stage Beacon", "Beacon"])
def test_types_that_do_not_correlate(spark, kind):
    assert pairs(rollups.correlated(findings(spark, beacon(1, "10.0.0.1"), beacon(2, "10.0.0.1", kind=kind)))) == {}


@pytest.mark.parametrize("src,dst", [("", "203.0.113.5"), ("10.0.0.1", ""), ("10.0.0.1", "(network)"), ("(cert)", "203.0.113.5"), ("(TI)", "203.0.113.5"), ("(escalation)", "203.0.113.5")])
def test_stand_ins_do_not_correlate(spark, src, dst):
    assert pairs(rollups.correlated(findings(spark, beacon(1, src, dst), beacon(2, src, dst, kind="Strobe")))) == {}


def test_internal_pairs_correlate_and_sensors_are_apart(spark):
    f = findings(spark, beacon(1, "10.0.0.1", "10.0.0.2"), beacon(2, "10.0.0.1", "10.0.0.2", kind="Lateral Movement", score=30), beacon(3, "10.0.0.3", sensor="s1"), beacon(4, "10.0.0.3", sensor="s2", kind="Strobe"))
    assert set(pairs(rollups.correlated(f))) == {("s1", "10.0.0.1", "10.0.0.2")}


def test_history_counts_and_the_run_speaks_first(spark):
    run = findings(spark, beacon(0, "10.0.0.1", score=50))
    old = findings(spark, beacon(7, "10.0.0.1", score=60), beacon(8, "10.0.0.1", kind="Strobe", at="2026-06-01 00:00:00", score=40))
    r = rollups.correlated(run, old)
    assert pairs(r) == {("s1", "10.0.0.1", "203.0.113.5"): (2, 60, "HIGH", "2026-06-01 00:00:00", "Beacon, Strobe")}
    assert {(m.member, m.historical) for m in r.members.collect()} == {(0, False), (8, True)}


def test_members_of_a_busy_pair_are_as_many_as_its_findings(spark):
    f = findings(spark, *((i, "Beacon" if i % 2 else "Strobe", 50, "s1", "10.0.0.1", "203.0.113.5", NOW, str(i)) for i in range(1, 401)))
    r = rollups.correlated(f)
    assert r.members.count() == 400 and r.findings.first().n_members == 400


def test_membership_survives_a_merge_and_a_second_run(spark):
    first = findings(spark, beacon(1, "10.0.0.1"), beacon(2, "10.0.0.1", kind="Strobe"), beacon(3, "10.0.0.9"))
    none = spark.createDataFrame([], FINDING)
    members = spark.createDataFrame([], "rollup_fp string, rollup long, fp string, member long")
    history = none
    for run, full, want in (
        (first, True, {"Beacon", "Strobe"}),
        (findings(spark, beacon(1, "10.0.0.1"), beacon(2, "10.0.0.1", kind="C2 Port")), True, {"Beacon", "Strobe", "C2 Port"}),  # Strobe is history by now
        (findings(spark, beacon(1, "10.0.0.9")), False, {"Beacon", "Strobe", "C2 Port"}),  # a partial run leaves it alone
    ):
        found = rollups.correlated(run, history) if full else rollups.Rollup(none.limit(0), members.withColumn("historical", F.lit(False)).limit(0))
        added = found.findings.select(*(c for c in found.findings.columns if c in run.columns))
        table = merge.merge_run(history, run.unionByName(added, allowMissingColumns=True) if full else run, NOW, full=full).persist()
        members = merge.merge_members(members, found.members, table, full).persist()
        history = table
        kinds = {r.id: r.type for r in table.collect()}
        held = members.collect()
        assert {kinds[m.member] for m in held} == want and {kinds[m.rollup] for m in held} == {"Correlated Activity"} and len(held) == len(want)


# Staging


def sources(spark, n=2, dst="203.0.113.5"):
    return spark.createDataFrame([("s1", dst, n)], "sensor string, dst string, n_sources long")


TWO = (beacon(1, "10.0.0.1"), beacon(2, "10.0.0.2", at="2026-06-08 10:30:00"))


def stage(spark, rows, history=None, n=2, dst="203.0.113.5"):
    return rollups.staged(findings(spark, *rows), findings(spark, *history) if history else None, sources(spark, n, dst))


def test_two_hosts_in_turn_are_staged(spark):
    r = stage(spark, TWO)
    f = r.findings.first()
    assert (f.score, f.severity, f.src_ip, f.dst_ip, f.timestamp, f.n_hosts) == (80, "HIGH", "10.0.0.1", "203.0.113.5", NOW, 2)
    assert f.detail == "2 internal hosts converging on external 203.0.113.5 \u2014 staged beacon onsets: 10.0.0.1@2026-06-08 10:00:00 10.0.0.2@2026-06-08 10:30:00"
    assert {(m.member, m.rollup, m.historical) for m in r.members.collect()} == {(1, f.id, False), (2, f.id, False)}


@pytest.mark.parametrize(
    "rows,n,dst",
    [
        (TWO, 7, "203.0.113.5"),  # not rare
        (TWO[:1], 1, "203.0.113.5"),  # one host
        ((TWO[0], beacon(2, "10.0.0.2", at="2026-06-11 10:00:00")), 2, "203.0.113.5"),  # too far apart
        ((beacon(1, "10.0.0.1", "10.0.0.9"), beacon(2, "10.0.0.2", "10.0.0.9")), 2, "10.0.0.9"),  # internal
        ((TWO[0], beacon(2, "10.0.0.2", at="")), 2, "203.0.113.5"),  # without a time
        ((TWO[0], beacon(2, "10.0.0.2", at="soon")), 2, "203.0.113.5"),  # without a readable one
        ((TWO[0], beacon(2, "10.0.0.2", kind="Strobe")), 2, "203.0.113.5"),  # no beacon
        ((TWO[0], beacon(2, "10.0.0.2", sensor="s2")), 2, "203.0.113.5"),  # another sensor's
    ],
)
def test_what_is_not_staged(spark, rows, n, dst):
    assert stage(spark, rows, n=n, dst=dst).findings.count() == 0


@pytest.mark.parametrize(
    "extra,reason",
    [
        (beacon(9, "10.0.0.1", "10.0.0.2", kind="Lateral Movement"), "lateral movement 10.0.0.1\u219210.0.0.2"),
        (beacon(9, "10.0.0.1", "10.0.0.3", kind="Lateral Movement"), None),  # one end is outside
        (beacon(9, "10.0.0.8", "10.0.0.2", kind="Lateral Movement"), None),
        (beacon(9, "10.0.0.1", "10.0.0.2", kind="Lateral Movement", sensor="s2"), None),
        (beacon(9, "10.0.0.7", kind="Malicious JA3"), "Malicious JA3 on C2 destination"),
        (beacon(9, "10.0.0.7", kind="Malicious JA4", sensor="s9"), "Malicious JA4 on C2 destination"),
        (beacon(9, "203.0.113.5", "10.0.0.7", kind="TI Hit (IP)"), "TI hit on C2 destination"),
        (beacon(9, "203.0.113.5", "10.0.0.7", kind="Malicious JA3"), None),
    ],
)
def test_what_confirms_a_staged_cluster(spark, extra, reason):
    for rows, history in (((*TWO, extra), None), (TWO, (extra,))):
        f = stage(spark, rows, history).findings.first()
        assert (f.reason, f.score, f.severity) == (reason, *((96, "CRITICAL") if reason else (80, "HIGH")))


def test_staging_over_a_run_and_the_history(spark):
    r = stage(spark, TWO[:1], (beacon(7, "10.0.0.2", at="2026-06-08 10:30:00"),))
    assert "10.0.0.2@2026-06-08 10:30:00" in r.findings.first().detail
    assert {(m.member, m.historical) for m in r.members.collect()} == {(1, False), (7, True)}
    assert stage(spark, TWO[:1], (beacon(7, "10.0.0.1"),)).findings.count() == 0  # the same beacon twice


def test_a_large_cluster_names_its_first_hosts_and_lists_all(spark):
    old = [beacon(i, f"10.0.{i // 200}.{i % 200}", at=f"2026-06-08 10:{i // 60:02}:{i % 60:02}") for i in range(10, 400)]
    r = stage(spark, TWO, old)
    f = r.findings.first()
    assert f.n_hosts == 392 and f.detail.count("@") == 50 and f.detail.endswith(" and 342 more") and r.members.count() == 392


# What beacons' texts say


def test_corroboration_by_egress(spark):
    kinds = ["Beacon", "HTTP Beacon", "DNS Beacon", "Port-Hopping Beacon", "Data Exfiltration", "Admin Protocol Egress", "Strobe", "Long Connection"]
    f = findings(spark, *(beacon(i, "10.0.0.1", kind=k) for i, k in enumerate(kinds)), beacon(20, "10.0.0.1", sensor="s2"), beacon(21, "10.0.0.2"))
    both = "Admin Protocol Egress, Data Exfiltration"
    assert {r.id: r.corroboration for r in matching.corroborated(f, f).filter("corroboration IS NOT NULL").collect()} == {0: both, 1: both, 3: both}
    said = {r.id: r.detail for r in matching.beacon_notes(f, detect.resolvers(queries(spark, "a.b").limit(0))).collect()}
    assert said[0] == f"x | Exfil-over-C2 corroboration: same destination also shows {both}." and said[2] == said[20] == "x"


def queries(spark, *names_, src="10.0.0.1"):
    return spark.createDataFrame([(float(i), "s1", src, "9.9.9.9", 53, n, "NOERROR", "203.0.113.1") for i, n in enumerate(names_)], "ts double, sensor string, src string, resolver string, port int, query string, rcode string, answers string")


def test_context_of_port_53(spark):
    at = lambda i, dst, sensor="s1", service="", port="53", kind="Beacon": (i, kind, 80, sensor, "10.0.0.1", dst, NOW, port, service)
    f = findings(spark, at(1, "9.9.9.9"), at(2, "9.9.9.8"), at(3, "9.9.9.8", service="ssl, DNS"), at(4, "9.9.9.9", sensor="s2"), at(5, "9.9.9.9", port="443"), at(6, "9.9.9.9", kind="HTTP Beacon"))
    got = {r.id: r.dns_context for r in matching.resolver_context(f, detect.resolvers(queries(spark, "a.example.com", "b.example.com", "c.net"))).collect()}
    assert got[1].startswith("active resolver for this source (3 queries, 2 domains)") and got[2].startswith("no DNS queries observed") and got[3].startswith("DPD recognized DNS") and set(got) == {1, 2, 3}
    many = detect.resolvers(queries(spark, *(f"d{i}.net" for i in range(600))))
    assert "(600 queries, 512+ domains)" in matching.resolver_context(f, many).filter("id = 1").first().dns_context


# Suffixes

LIST = ["// rules", "", "com", "uk", "co.uk", "*.ck", "!www.ck", "*.bd  trailing words", "COM.AC.", "github.io", "*.compute.example", "!city.kawasaki.jp", "*.kawasaki.jp", "jp"]
APEXES = {
    "a.b.example.com": "example.com",
    "bbc.co.uk": "bbc.co.uk",
    "x.bbc.co.uk": "bbc.co.uk",
    "co.uk": "co.uk",
    "com": "com",
    "a.www.ck": "www.ck",
    "www.ck": "www.ck",
    "b.c.d.ck": "c.d.ck",
    "c.d.ck": "c.d.ck",
    "d.ck": "d.ck",
    "x.y.com.ac": "y.com.ac",
    "me.github.io": "me.github.io",
    "a.me.github.io": "me.github.io",
    "q.w.e.compute.example": "w.e.compute.example",
    "a.city.kawasaki.jp": "city.kawasaki.jp",
    "a.b.other.kawasaki.jp": "b.other.kawasaki.jp",
    "a.unlisted.zone": "unlisted.zone",
    "host": "host",
    "a..com": ".com",
    "end.com.": "end.com",
}


def test_registrable_domains_by_rules(spark):
    rules = names.suffix_rules(spark.createDataFrame([(x,) for x in LIST], "value string"))
    rows = spark.createDataFrame([(q,) for q in [*APEXES, None]], "query string")
    got = {r.query: r.apex for r in names.with_apex(rows, rules).collect()}
    assert got == APEXES | {None: None}


def test_a_list_of_ten_thousand_rules_through_every_dns_detector(spark):
    rng = random.Random(7)
    made = ["".join(rng.choices("abcdefghij", k=6)) + rng.choice([".uk", ".jp", ".com.br"]) for _ in range(10_000)]
    rules = names.suffix_rules(spark.createDataFrame([(x,) for x in [*LIST, *made]], "value string"))
    dns = queries(spark, f"x.y.{made[5]}", f"{'q' * 60}.y.{made[5]}", f"w.y.{made[5]}", "bad.tk")
    assert {r.apex for r in detect.resolved(dns, suffixes=rules).collect()} == {f"y.{made[5]}", "bad.tk"}
    assert {r.dst_ip for r in detect.tunneling(dns, suffixes=rules).collect()} == {f"y.{made[5]}"}
    assert {r.dst_ip for r in detect.suspicious_tld(dns, suffixes=rules).collect()} == {"bad.tk"}
    assert {(r.apex, r.n_subs) for r in detect.subdomains(dns, suffixes=rules).collect()} == {(f"y.{made[5]}", 3), ("bad.tk", 0)}
    assert detect.resolvers(dns, suffixes=rules).first().apexes == 2


# Lists


def brute(value, entries):
    import re
    from ipaddress import ip_address, ip_network

    out = set()
    for e in entries:
        if re.search("[*?]", e):
            hit = re.fullmatch("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in e.lower()), value.lower(), re.S)
        elif "/" in e:
            try:
                hit = ip_address(value) in ip_network(e, strict=False)
            except ValueError:
                hit = False
        else:
            hit = e.lower() == value.lower()
        if hit:
            out.add(e)
    return out


def test_lists_of_all_kinds_match_as_by_brute_force(spark):
    rng = random.Random(3)
    word = lambda a="abc.": "".join(rng.choices(a, k=rng.randint(1, 7)))
    entries = {*("".join(rng.choices("ab.*?", k=rng.randint(1, 9))) for _ in range(300)), "*", "??", "*?", "a_b%", "*a_b%*", "x\\y*", "10.0.0.0/8", "203.0.113.0/29", "2001:db8::/33", "203.0.113.5", "AB.C"}
    values = {*(word() for _ in range(200)), "a_b%", "aXbY", "za_b%z", "x\\yz", "10.9.8.7", "203.0.113.5", "203.0.113.9", "2001:db8:0:1::7", "2001:db8:8000::1"}
    got: dict = {v: set() for v in values}
    for r in matching.matches(spark.createDataFrame([(v,) for v in values], "ip string"), "ip", spark.createDataFrame([(e,) for e in entries], "value string")).collect():
        got[r.ip].add(r.value)
    assert got == {v: brute(v, entries) for v in values}


def test_a_hundred_thousand_wildcards_need_no_larger_plan(spark):
    values = spark.createDataFrame([(f"h{i}.site{i}.example",) for i in range(50)] + [("none.example",)], "dst string")
    sizes = []
    for n in (60, 100_000):
        entries = spark.range(n).select(F.concat(F.lit("*.site"), F.col("id").cast("string"), F.lit(".*")).alias("value"))
        found = matching.matches(values, "dst", entries)
        sizes.append(len(found._jdf.queryExecution().analyzed().toString()))
        assert {(r.dst, r.value) for r in found.collect()} == {(f"h{i}.site{i}.example", f"*.site{i}.*") for i in range(50)}
    assert abs(sizes[0] - sizes[1]) < 0.02 * sizes[0]


def test_pair_rules_of_hundreds_of_shapes(spark):
    rules = [(f"10.0.0.0/{n}" if n else "", d, p, t, s) for n in (0, *range(8, 33)) for d in ("", "203.0.113.0/24", "*.example.com") for p in ("", "443") for t in ("", "Beacon") for s in ("", "s2")]
    rules = [r for r in rules if sum(map(bool, r)) >= 3 or r[0] == "10.0.0.0/32"]
    f = findings(spark, beacon(1, "10.0.0.0"), beacon(2, "10.0.0.1"), beacon(3, "11.0.0.1"), beacon(4, "10.200.0.1", "x.example.com"), beacon(5, "11.0.0.1", "example.com"), beacon(6, "11.0.0.1", "198.51.100.1", sensor="s2"), beacon(7, "11.9.9.9", sensor="s2"))
    kind = "src string, dst string, port string, finding_type string, sensor string"
    few, many = (matching.hide_pairs(f, spark.createDataFrame(rs, kind)) for rs in (rules[:1], rules))
    assert len({(r[0].partition("/")[2], r[1][:2], *map(bool, r[2:])) for r in rules}) > 400
    sides = lambda x: x._jdf.queryExecution().analyzed().toString().count("\n")
    assert sides(few) == sides(many)

    def hidden(r):
        for src, dst, port, kind_, sensor in rules:
            ip = sum(int(x) << 8 * (3 - i) for i, x in enumerate(r.src_ip.split(".")))
            ok = not src or ip >> 32 - int(src[9:]) == (10 << 24) >> 32 - int(src[9:])
            ok = ok and (not dst or (dst[0] == "*" and (r.dst_ip.endswith(dst[1:]) or r.dst_ip == dst[2:])) or (dst[0] == "2" and r.dst_ip.startswith("203.0.113.")))
            if ok and port in ("", r.dst_port) and kind_ in ("", r.type) and sensor in ("", r.sensor):
                return True
        return False

    assert {r.id for r in many.collect()} == {r.id for r in f.collect() if not hidden(r)}


def test_rules_that_cannot_be_read_hide_nothing_and_the_empty_rule_hides_all(spark):
    f, kind = findings(spark, *TWO), "src string, dst string, port string, finding_type string, sensor string"
    assert matching.hide_pairs(f, spark.createDataFrame([("10.0.0.0/99", "", "", "", ""), ("nonsense/8", None, None, None, None)], kind)).count() == 2
    assert matching.hide_pairs(f, spark.createDataFrame([(None, None, None, None, None)], kind)).count() == 0
    assert matching.hide_pairs(f, spark.createDataFrame([], kind)).count() == 2


def test_suggestions_cover_identity_and_wildcard_rules(spark):
    row = lambda day, host="h1", sensor="s1", kind="HTTP Beacon", score=60: (kind, "10.0.0.1", "203.0.113.5", "443", host, "/a", sensor, f"2026-06-{day:02}", score)
    history = spark.createDataFrame([row(d) for d in range(1, 15)] + [row(d, host="h2") for d in range(1, 14)] + [row(d, sensor="") for d in range(1, 16)] + [row(d, sensor="s2") for d in range(1, 20)], "finding_type string, src_ip string, dst_ip string, dst_port string, host string, uri string, sensor string, day string, max_score int")
    f = findings(spark, beacon(1, "10.0.0.1", kind="HTTP Beacon")).withColumn("status", F.lit("acknowledged")).withColumn("analyst", F.lit("me"))
    kind = "src string, dst string, port string, finding_type string, sensor string"
    got = lambda *rules: {(r.host, r.sensor, r.days, r.acked_by) for r in matching.suggested(history, f, spark.createDataFrame(rules, kind)).collect()}
    assert got() == {("h1", "s1", 14, "me"), ("h1", "", 15, "me")}
    assert got(("10.0.0.1", "203.0.113.5", "443", "", "")) == set() and got(("10.0.0.1", "203.0.113.5", "443", None, "s1")) == {("h1", "", 15, "me")}
    assert len(got(("10.0.0.1", "203.0.113.5", "443", "Beacon", ""), ("10.0.0.1", "", "443", "", ""))) == 2


# Files, fingerprints, reports


def test_file_records_fall_back_to_the_connection(spark):
    rows = [(1.0, "[]", "(empty)", "198.51.100.1", "10.0.0.1", "application/x-dosexec", "a", "AA"), (2.0, "198.51.100.2,1.1.1.1", "10.0.0.2", "1.1.1.1", "2.2.2.2", "text/html", "b.ps1", ""), (3.0, None, None, None, "10.0.0.3", "text/html", "c.exe", None)]
    f = spark.createDataFrame(rows, "ts double, tx string, rx string, src string, dst string, mime_type string, filename string, md5 string").withColumn("rx", F.when(F.col("rx") == "(empty)", None).otherwise(F.col("rx")))
    assert {(r.src_ip, r.dst_ip) for r in detect.file_download(f.withColumn("sensor", F.lit("s"))).collect()} == {("10.0.0.1", "198.51.100.1"), ("10.0.0.2", "198.51.100.2")}
    hits = matching.hash_hits(f, spark.createDataFrame([("aa", "f")], "value string, feed string"), ("md5",)).collect()
    assert [(r.rx, r.tx, r.hash) for r in hits] == [("10.0.0.1", "198.51.100.1", "aa")]


def test_concern_by_kind(spark):
    rows = [("ja4", "a", 1, 2, 8), ("ja4", "b", 1, 1, 8), ("ja3", "c", 1, 2, 8), ("ja3", "d", 1, 1, 8), ("ja4", "e", 1, 9, 9), ("ja3", "f", 1, 9, 9)]
    p = spark.createDataFrame(rows, "kind string, fp string, conns long, srcs long, dsts long")
    assert {r.fp: r.concern for r in reports.concern(p).collect()} == {"a": "critical", "b": "high", "c": "medium", "d": "low", "e": "none", "f": "none"}
    bad, benign = spark.createDataFrame([("ja3", "f", "C2")], "kind string, fp string, label string"), spark.createDataFrame([("ja3", "f"), ("ja4", "b"), ("ja3", "a")], "kind string, fp string")
    assert {r.fp: (r.concern, r.rank) for r in reports.inventory(p, bad, benign).collect()} == {"a": ("critical", 0), "c": ("medium", 2), "f": ("critical", 0)}


# Evidence


def test_nearest_records_are_those_of_a_search_through_all(spark):
    rng = random.Random(11)
    own = [(i, "a", "b" if i % 3 else "c", float(rng.randint(0, 40_000))) for i in range(60)]
    records = [(f"u{i:04}", "a", rng.choice("bcd"), float(rng.randint(0, 400) * 100)) for i in range(1500)]
    f = spark.createDataFrame(own, "id long, src_ip string, dst_ip string, at double")
    r = spark.createDataFrame(records, "uid string, src string, dst string, ts double")
    want = set()
    for i, src, dst, at in own:
        near = sorted((abs(ts - at), ts, uid) for uid, s, d, ts in records if (s, d) == (src, dst) and abs(ts - at) <= 7200)
        want |= {(i, uid, k) for k, (_, _, uid) in enumerate(near[:5], 1)}
    assert {(x.id, x.uid, x.place) for x in matching.evidence(f, r, most=5).collect()} == want


def test_generated_names_need_no_job_and_no_table_in_the_plan(spark):
    """The bigrams are joined: neither collected while the plan is made nor written into it."""
    letters = spark.range(676).select(F.concat(*(F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), k.cast("int") + 1, F.lit(1)) for k in (F.floor(F.col("id") / 26), F.col("id") % 26))).alias("bigram"), F.lit(-9.0).alias("logp"))
    rows = spark.createDataFrame([(1, "Beacon", "xqzvkjwpqx.net", 80, "HIGH"), (2, "Strobe", "xqzvkjwpqx.net", 80, "HIGH"), (3, "Beacon", None, 80, "HIGH"), (4, "Beacon", "xqzvkjwpqq.net", 80, "HIGH")], "id int, type string, hostname string, score int, severity string")
    got = detect.dga(rows, letters, cfg=Config(dga_entropy=2.5), allowed=spark.createDataFrame([("xqzvkjwpqq",)], "value string"))
    assert {r.id: (r.dga, r.score) for r in got.collect()} == {1: (True, 95), 2: (False, 80), 3: (False, 80), 4: (False, 80)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("-9.0") < 10


def test_corroborating_rows_are_reduced_before_they_meet_clusters(spark):
    kind = "_p int, id long, type string, sensor string, src_ip string, dst_ip string"
    moves = [(i % 2, i, "Lateral Movement", "s1", "10.0.0.1", "10.0.0.2") for i in range(2, 40)]
    hits = [(1, i, "TI Hit (IP)", "s1", "10.0.0.1", "203.0.113.5") for i in range(50, 60)] + [(0, i, "Malicious JA3", "s1", "10.0.0.1", "203.0.113.5") for i in range(60, 70)]
    related = spark.createDataFrame(moves + hits, kind)
    assert [tuple(r) for r in rollups._moves(related).collect()] == [("s1", "10.0.0.1", "10.0.0.2", 0, 2)]
    assert sorted(tuple(r) for r in rollups._hits(related).collect()) == [("10.0.0.1", "TI hit on C2 destination", 1, 50), ("203.0.113.5", "Malicious JA3 on C2 destination", 0, 60), ("203.0.113.5", "TI hit on C2 destination", 1, 50)]


def test_wildcards_are_filed_under_their_rarest_piece_with_any_characters_in_it(spark):
    ends = [f"*{a}{b}?{c}*.tun.*" for a in "abcd" for b in "abcd" for c in "xyz"]
    odd = ["*", "??", "*q", "z*", "a.b?c", "*[x]?y*", "50%?_", "h1.*.?o.uk", "*", "*b\\d*"]
    globs = spark.createDataFrame([(g,) for g in ends + odd], "value string")
    ready = matching.listed(globs)
    most = ready.keys.filter("value LIKE '%.tun.%'").groupBy("_p").count().agg(F.max("count")).first()[0]
    assert most == 1 and "##?#" in ready.shapes and len(ready.shapes) <= 71
    texts = ["aabqx.tun.com", "00dc1z00.tun.x", "dc1z.tun", "q", "zz", "zq", "a.bbc", "a.b?c", "AB[X]qYY", "50%1_", "5011_", "h1.click.co.uk", "h11.click.co.uk", "b\\d", ""]
    want = {(x, g) for x in texts for g in ends + odd if re.fullmatch("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in g.lower()), x.lower())}
    got = matching.matches(spark.createDataFrame([(x,) for x in texts], "name string"), "name", ready).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_addresses_out_of_range_count_by_their_spelling_where_a_query_asks_for_it(spark, tmp_path):
    import __spark_entry__

    duckdb = pytest.importorskip("duckdb")
    duck, at = duckdb.connect(), str(tmp_path)
    for t in ("events", "nation"):
        duck.sql(f"COPY (SELECT * {'REPLACE (user_id + 70000 AS user_id)' if t == 'events' else ''} FROM '/root/testdata/sf0.001/{t}.parquet') TO '{at}/{t}.parquet'")
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    for name in ("pred_direction", "export_triage_lines", "red_pseudonyms", "red_names", "roll_sibling_ids"):
        df = __spark_entry__.queries()[name](spark, at)
        want = duck.sql(f"SELECT {', '.join(df.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
        assert sorted(tuple(r) for r in df.collect()) == sorted(want) and want, name
    bad = spark.createDataFrame([(1, "10.0.300.5", "8.8.8.8", "10.0.300.5 to 8.8.300.8")], "id int, src string, dst string, text string")
    assert bad.filter(E.direction_is("src", "dst", "outbound")).count() == 0
    assert redact.redacted(bad.select("id", "text"))[0].first().text == "10.0.300.5 to 8.8.300.8"
    assert redact.redacted(bad.select("id", "text"), spelled=True)[0].first().text == "HOST_1 to 8.8.300.8"


def test_all_findings_ask_for_their_siblings():
    import __spark_entry__

    assert "WHERE status = 'escalated'" not in __spark_entry__.oracle_sql()["roll_sibling_ids"]


def test_counted_contacts_give_the_same_hits(spark):
    conn = spark.createDataFrame([("203.0.113.9", "10.0.0.1", t, p) for t, p in ((3.0, 443), (1.0, 80), (2.0, 22))], "dst string, src string, ts double, port int")
    http = spark.createDataFrame([("C2.example:80", "10.0.0.2", 5.0, 80), ("c2.example", "10.0.0.2", 4.0, 8080)], "host string, src string, ts double, port int")
    named = spark.createDataFrame([("only.example",), ("only.example",)], "dst_ip string")
    listed = spark.createDataFrame([("203.0.113.0/24", "a", 90), ("c2.example", "b", 96), ("only.example", "c", 91)], "value string, feed string, score int")
    rows, groups = (matching.destinations(conn, None, http, named, counted=c) for c in (False, True))
    assert (rows.count(), groups.count()) == (7, 4)
    plain, fewer = (sorted(map(str, matching.threat_hits(x, listed).collect())) for x in (rows, groups))
    assert plain == fewer and len(plain) == 3


def test_a_merge_joins_and_reads_its_tables_once(spark):
    run, old = findings(spark, beacon(1, "10.0.0.1"), beacon(2, "10.0.0.1", kind="Strobe")), findings(spark, beacon(7, "10.0.0.1"))
    found = rollups.correlated(run, old)
    table = merge.merge_run(old, run.unionByName(found.findings.select(*(c for c in found.findings.columns if c in run.columns)), allowMissingColumns=True), NOW)
    for df, most in ((found.members, 2), (table, 8)):  # what is read for the result alone; before, each step was made anew for each of its readers
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") + plan.count("LogicalRDD") + plan.count("LocalRelation") <= most


def test_repeated_entries_are_told_apart_before_their_kind_is_found(spark, monkeypatch):
    asked = []
    kept = matching.typed
    monkeypatch.setattr(matching, "typed", lambda entries, *more: (asked.append(entries.count()), kept(entries, *more))[1])
    entries = spark.createDataFrame([("203.0.113.0/24", "f"), ("198.51.100.1", "f"), ("*.example.net", "g")] * 200, "value string, feed string")
    ready = matching.listed(entries)
    assert asked == [3] and ready.keys.count() == 3  # before: 600
    ready.close()
