"""Planted signals with expected values worked out by hand, and the same results whatever the layout."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from packetloom.config import Config
from packetloom.functions import exprs as E
from packetloom.operators import beacon, detect, matching, merge, reports, rollups, stats
from packetloom.sources import lists, logs, redact, sinks
from packetloom.streaming import stream

T0 = 1_705_320_000.0


def conn(spark, rows):
    """rows: (ts, src, dst, port, service, orig, resp, duration)."""
    data = [(f"C{i}", float(r[0]), "s0", *r[1:]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "uid string, ts double, sensor string, src string, dst string, port int, service string, orig_bytes double, resp_bytes double, duration double")


def steady(n=100, gap=60.0, dst="203.0.113.9", ports=(443,)):
    return [(T0 + i * gap, "10.0.0.5", dst, ports[i % len(ports)], "ssl", 100.0, 50.0, 1.0) for i in range(n)]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_fixed_cadence(spark):
    p = beacon.profile(conn(spark, steady())).first()
    assert (p.n, p.mean_iv, p.median_iv, p.cv, p.ts_raw, p.ts_score, p.ds_score, p.conf) == (100, 60.0, 60.0, 0.0, 1.0, 1.0, 1.0, 1.0)


def test_layout_makes_no_difference(spark):
    df = conn(spark, steady(60, ports=(443, 80)) + steady(40, 45.0, "203.0.113.8"))
    one = sorted(map(str, beacon.profile(df.orderBy(F.rand(1)).repartition(7)).collect()))
    assert one == sorted(map(str, beacon.profile(df.coalesce(1)).collect()))


def test_two_modes(spark):
    gaps = [60.0, 600.0] * 30
    ts = [T0 + sum(gaps[:i]) for i in range(61)]
    p = beacon.profile(conn(spark, [(t, "10.0.0.5", "203.0.113.9", 443, "ssl", 100.0, 1.0, 1.0) for t in ts])).first()
    assert p.ts_mm == 1.0 and p.ts_score == 1.0 and p.ts_raw < 1.0


@pytest.mark.parametrize("xs,want", [([1.0, 2.0, 3.0, 4.0], 2.5), ([5.0], 5.0), ([], 0.0)])
def test_median(spark, xs, want):
    assert value(spark, stats.median(F.lit(xs).cast("array<double>"))) == want


def test_bowley_and_mad(spark):
    xs = F.array(*map(F.lit, [10.0, 11.0, 12.0, 20.0, 40.0]))
    # Halves without the middle: quartiles 10.5 and 30, median 12.
    assert abs(value(spark, stats.bowley(xs)) - (1 - (10.5 + 30 - 24) / 19.5)) < 1e-12
    assert abs(value(spark, stats.mad(xs, 1.0)) - (12 - 2) / 12) < 1e-12
    assert value(spark, stats.mad(F.array().cast("array<double>"), 0.5)) == 0.5


def test_arrival_order_does_not_rewind(spark):
    rows = [(1, 10.0), (2, 30.0), (3, 20.0), (4, 40.0)]
    df = spark.createDataFrame(rows, "seq int, ts double").withColumn("k", F.lit("k"))
    assert [r.iv for r in stats.intervals(df, ["k"], seq="seq").orderBy("seq").collect()] == [None, 20.0, None, 10.0]
    assert [r.iv for r in stats.intervals(df, ["k"]).orderBy("ts").collect()] == [None, 10.0, 10.0, 10.0]


def test_ports_hop(spark):
    p = beacon.ports(conn(spark, steady(36, ports=(1, 2, 3, 4, 5, 6)))).first()
    assert (p.modal_port, p.n_ports, p.hops) == (1, 6, True)
    p = beacon.ports(conn(spark, steady(48, ports=(443, 443, 80)))).first()
    assert (p.modal_port, p.hops, p.co_traffic) == (443, False, "80x16")


def test_periodicity_finds_the_planted_period(spark):
    draw = random.Random(1)
    rows = [(T0 + i * 300 + draw.uniform(0, 100), "10.0.0.5", "203.0.113.9", 443, "ssl", 1.0, 1.0, 1.0) for i in range(200)]
    r = stats.periodicity(conn(spark, rows), ["src"], grid=2000).first()
    assert abs(r.period - 300) < 3 and r.spectral_score > 0.5


def test_exfiltration_strobe_and_long(spark):
    rows = [(T0 + i, "10.0.0.5", "203.0.113.9", 443, "ssl", 1.5e6, 5e4, 1.0) for i in range(5)]
    r = detect.exfiltration(conn(spark, rows)).first()
    assert (r.severity, r.score, r.dst_ip) == ("CRITICAL", 66, "203.0.113.9")
    r = detect.strobe(conn(spark, steady(200, 1.0))).first()
    assert (r.severity, r.score) == ("HIGH", 84)
    assert detect.strobe(conn(spark, steady(200, 1.0, "224.0.0.251"))).count() == 0
    r = detect.long_connection(conn(spark, [(T0, "10.0.0.5", "203.0.113.9", 1, "", 1.0, 1.0, 90_000.0)])).first()
    assert (r.severity, r.score) == ("HIGH", 53)


def test_service_detections(spark):
    rows = [
        (T0, "10.0.0.5", "10.0.0.6", 3389, None, 1.0, 1.0, 1.0),
        (T0, "10.0.0.5", "10.0.0.7", 443, "rdp", 1.0, 1.0, 1.0),
        (T0, "10.0.0.5", "203.0.113.9", 4444, None, 1.0, 1.0, 1.0),
        (T0, "10.0.0.5", "203.0.113.9", 8888, "http", 1.0, 1.0, 1.0),
        (T0, "10.0.0.5", "203.0.113.9", 4444, "ssl,http", 1.0, 1.0, 1.0),
        (T0, "10.0.0.5", "203.0.113.9", 22, "ssh", 1.0, 1.0, 1.0),
        (T0, "10.0.0.5", "203.0.113.9", 3306, "mysql", 1.0, 1.0, 1.0),
    ]
    df = conn(spark, rows)
    got = lambda d: sorted((r.dst_ip, r.dst_port, r.score) for r in d(df).collect())
    assert got(detect.lateral) == [("10.0.0.6", "3389", 78), ("10.0.0.7", "443", 78)]
    assert got(detect.c2_port) == [("203.0.113.9", "4444", 75), ("203.0.113.9", "8888", 50)]
    assert got(detect.unexpected_port) == [("203.0.113.9", "4444", 75)]
    assert got(detect.admin_egress) == [("203.0.113.9", "22", 50)]
    assert got(detect.database_egress) == [("203.0.113.9", "3306", 72)]


def test_certificates(spark):
    rows = [
        (T0, "u1", "CN=a", "CN=A", "0", "31536000"),
        (T0, "u2", "CN=localhost", "CN=b", "2024-01-01T00:00:00Z", "2025-01-01T00:00:00Z"),
        (T0, "u3", "CN=c", "CN=d", "0", "3600"),
        (T0, "u4", "CN=e", "CN=f", "0", "315361000"),
        (T0, "u5", "CN=g", "CN=h", "0", "31536000"),
    ]
    df = spark.createDataFrame(rows, "ts double, uid string, subject string, issuer string, not_before string, not_after string")
    assert sorted((r.dst_ip, r.detail) for r in detect.certificates(df).collect()) == [("CN=a", "self-signed"), ("CN=c", "short validity"), ("CN=e", "validity > 10 years"), ("CN=localhost", "default subject localhost")]


def test_generated_names(spark):
    words = spark.createDataFrame([("the quick brown fox jumps over the lazy dog and then the other hen",)], "text string")
    rows = spark.createDataFrame([("xqzvkjwpqx.net", 80, "HIGH"), ("theotherhen.net", 80, "HIGH"), ("10.0.0.1", 80, "HIGH"), ("xqzvkjwpq.cloudfront.net", 80, "HIGH")], "hostname string, score int, severity string")
    got = {r.hostname: (r.dga, r.score, r.severity) for r in detect.dga(rows, detect.bigram_table(words), cfg=Config(dga_entropy=2.5)).collect()}
    assert got["xqzvkjwpqx.net"] == (True, 95, "CRITICAL")
    assert not any(v[0] for k, v in got.items() if k != "xqzvkjwpqx.net")


@pytest.mark.parametrize(
    "make,arg,want",
    [
        (E.is_private, "172.31.0.1", True),
        (E.is_private, "172.32.0.1", False),
        (E.is_private, "fda.gov", False),
        (E.is_private_ungated, "fda.gov", True),
        (E.is_private, "fd00::1", True),
        (E.is_local_infra, "224.0.0.251", True),
        (E.is_local_infra, "fe80::1", True),
        (E.is_local_infra, "203.0.113.1", False),
        (E.ip_key, "1.2.3.4", 16909060),
        (E.ip_key, "1.2.3.400", None),
        (E.apex, "a.b.example.co.uk", "example.co.uk"),
        (E.apex, "a.b.example.org", "example.org"),
        (E.second_level, "a.b.example.org", "example"),
        (E.host_without_port, "h.net:8080", "h.net"),
        (E.is_cdn, "x.cloudfront.net", True),
        (E.entropy, "aabb", 1.0),
        (E.entropy, "", 0.0),
        (E.first_address, '["10.0.0.1","10.0.0.2"]', "10.0.0.1"),
        (E.valid_hash, "d41d8cd98f00b204e9800998ecf8427e", True),
        (E.valid_domain, "not a domain", False),
        (E.human_bytes, "1500000", "1.5 MB"),
        (E.human_duration, "3700", "1h1m"),
        (E.host_class, "127.0.0.1", "loopback"),
    ],
)
def test_scalars(spark, make, arg, want):
    assert value(spark, make(F.lit(arg))) == want


def test_lists_and_ranges(spark):
    values = spark.createDataFrame([(v,) for v in ("10.1.2.3", "10.9.0.1", "evil.example.com", "203.0.113.77", None)], "ip string")
    entries = spark.createDataFrame([(v,) for v in ("10.1.0.0/16", "203.0.113.64/26", "203.0.113.77", "*.example.com", "0.0.0.0/0")], "value string")
    got = {(r.ip, r.value) for r in matching.matches(values, "ip", entries).collect()}
    assert got == {("10.1.2.3", "10.1.0.0/16"), ("203.0.113.77", "203.0.113.64/26"), ("203.0.113.77", "203.0.113.77"), ("evil.example.com", "*.example.com")} | {(ip, "0.0.0.0/0") for ip in ("10.1.2.3", "10.9.0.1", "203.0.113.77")}


def found(spark, rows):
    cols = "id long, type string, severity string, score int, src_ip string, dst_ip string, dst_port string, detail string, timestamp string, sensor string, status string, analyst string, analyst_note string, detected_at string, is_new boolean, ioc_match boolean, hostname string, uri string, notes array<string>"
    data = [(i, t, s, sc, a, b, p, "d", "2024-01-01 00:00:00", "s0", st, "", "", "2024-01-01 00:00:00", False, False, h, None, n) for i, t, s, sc, a, b, p, st, h, n in rows]
    return spark.createDataFrame(data, cols)


def test_merge_keeps_identity_and_triage(spark):
    old = found(spark, [(1, "Beacon", "HIGH", 70, "10.0.0.1", "203.0.113.1", "443", "acknowledged", None, None), (2, "Host Risk Score", "HIGH", 70, "10.0.0.1", "(network)", None, "", None, None), (3, "Strobe", "HIGH", 80, "10.0.0.2", "203.0.113.2", None, "", None, None)])
    run = found(spark, [(9, "Beacon", "CRITICAL", 90, "10.0.0.1", "203.0.113.1", "443", "", None, None), (9, "Beacon", "LOW", 40, "10.0.0.1", "203.0.113.1", "443", "", None, None), (9, "C2 Port", "HIGH", 75, "10.0.0.4", "203.0.113.4", "4444", "", None, None)]).drop("id")
    got = {r.id: (r.type, r.score, r.status, r.is_new) for r in merge.merge_run(old, run, "2024-01-02 00:00:00").collect()}
    assert got == {1: ("Beacon", 90, "acknowledged", False), 3: ("Strobe", 80, "", False), 4: ("C2 Port", 75, "", True)}
    assert merge.merge_run(old, run, "2024-01-02 00:00:00", full=False).count() == 4


def test_notes_status_and_positions(spark):
    f = found(spark, [(i, "Beacon", "HIGH", 50 + i, "10.0.0.1", "203.0.113.1", "443", "", None, ["a"] if i == 1 else None) for i in range(1, 6)])
    notes = merge.add_notes(f, spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id long, note string"))
    assert {r.id: r.notes for r in notes.collect()} == {1: ["a", "b"], 2: ["c"], 3: None, 4: None, 5: None}
    new, before = merge.set_status(f, f.filter("id > 3").select("id"), "dismissed", "me")
    assert new.filter("status = 'dismissed'").count() == 2 and before.count() == 2
    assert reports.position(f, 4) == 2 and reports.position(f, 99) is None


def test_rollups(spark):
    f = found(spark, [(1, "Beacon", "CRITICAL", 90, "10.0.0.1", "203.0.113.1", "443", "", None, None), (2, "Malicious JA3", "CRITICAL", 95, "10.0.0.1", "203.0.113.1", "443", "", None, None), (3, "Beacon", "LOW", 40, "10.0.0.2", "203.0.113.2", "443", "", None, None)])
    found_, members = rollups.correlated(f)
    r = found_.first()
    assert (r.src_ip, r.n_types, r.score, r.severity, r.id, r.n_members) == ("10.0.0.1", 2, 95, "CRITICAL", 4, 2)
    risk = {r.src_ip: (r.raw, r.score, r.severity) for r in rollups.host_risk(f).collect()}
    assert risk["10.0.0.2"] == (21, 21, "LOW") and risk["10.0.0.1"] == (68, 68, "HIGH")
    assert {(r.id, r.sibling) for r in rollups.siblings_of(f.select("id"), members).collect()} == {(1, 2), (2, 1)}
    assert {r.id: r.rollup for r in rollups.with_rollup(f, members).collect()} == {1: 4, 2: 4, 3: None}


def test_json_and_tsv_logs(spark, tmp_path):
    day = tmp_path / "north" / "2024-01-15"
    day.mkdir(parents=True)
    row = {"ts": T0, "uid": "S1", "id.orig_h": "192.168.1.50", "id.resp_h": "203.0.113.10", "id.resp_p": 8443, "service": "-", "orig_bytes": 0, "orig_ip_bytes": 40}
    with gzip.open(day / "conn.00.log.gz", "wt") as f:
        f.write(json.dumps(row) + "\nnot json\n")
    (day / "connection.log").write_text(json.dumps(row) + "\n")
    got = logs.read(spark, str(tmp_path), "conn").collect()
    assert [(r.src, r.port, r.service, r.orig_bytes, r.sensor, str(r.log_date)) for r in got] == [("192.168.1.50", 8443, None, 40.0, "north", "2024-01-15")]
    q = logs.quality(spark, str(tmp_path), "conn").first()
    assert (q.lines, q.parsed, q.error) == (2, 1, False)
    (day / "dns.log").write_text("#separator \\x09\n#fields\tts\tid.orig_h\tquery\trcode_name\tanswers\n1.5\t10.0.0.1\ta.b\tNOERROR\t1.1.1.1,2.2.2.2\n2.5\t10.0.0.2\t(empty)\n")
    got = sorted((r.ts, r.src, r.query, r.rcode, r.answers) for r in logs.read(spark, str(tmp_path), "dns", fmt="tsv").collect())
    assert got == [(1.5, "10.0.0.1", "a.b", "NOERROR", "1.1.1.1,2.2.2.2"), (2.5, "10.0.0.2", None, None, None)]
    q = logs.quality(spark, str(tmp_path), "dns").first()
    assert (q.lines, q.parsed, q.error) == (2, 2, False)
    inv = logs.inventory(spark, str(tmp_path)).first()
    assert (inv.sensor, inv.files) == ("north", 3)
    assert logs.dataset_fingerprint(spark, str(tmp_path)) == logs.dataset_fingerprint(spark, str(tmp_path))
    assert logs.retention_plan(spark, str(tmp_path), "2024-02-01").first().files == 3


def test_list_files_and_dumps(spark):
    lines = spark.createDataFrame([(" 1.2.3.4 # x",), ("# only",), ("1.2.3.4",), ("",)], "value string")
    assert [r.value for r in lists.entries(lines).collect()] == ["1.2.3.4"]
    dump = spark.createDataFrame([("ip-dst", "1.2.3.4", ["a"]), ("domain|ip", "Evil.COM|5.6.7.8", None), ("ip-src", "bad", None), ("md5", "d41d8cd98f00b204e9800998ecf8427e", ["b"]), ("ip-dst", "10.0.0.0/8", None)], "type string, value string, tags array<string>")
    assert {(r.value, r.kind) for r in lists.attributes(dump, "m").collect()} == {("1.2.3.4", "ip"), ("evil.com", "domain"), ("5.6.7.8", "ip"), ("d41d8cd98f00b204e9800998ecf8427e", "hash"), ("10.0.0.0/8", "cidr")}
    stix = spark.createDataFrame([("[domain-name:value = 'Evil.com']",), ("[ipv4-addr:value = '1.2.3.4']",), ("[x:y = 'z']",)], "pattern string")
    assert {(r.value, r.kind) for r in lists.patterns(stix, "o").collect()} == {("evil.com", "domain"), ("1.2.3.4", "ip")}


def test_exports(spark, tmp_path):
    f = found(spark, [(1, "Beacon", "HIGH", 77, "10.0.0.1", "203.0.113.1", "443", "", "=h", ["triage: verdict: Likely benign; confidence: 80; reason: known host"]), (2, "Strobe", "LOW", 40, "10.0.0.2", "x", None, "", None, None)])
    assert [r.hostname for r in sinks.csv_rows(f).orderBy("id").collect()] == ["'=h", None]
    assert sinks.cef_lines(f).filter("value LIKE 'CEF:0|%|Beacon|Beacon|7|src=10.0.0.1 %'").count() == 1
    t = sinks.triage(f).first()
    assert (t.id, t.verdict, t.confidence, t.reason) == (1, "likely benign", 80, "known host")
    sinks.publish(f.limit(1), str(tmp_path / "t"))
    version = sinks.publish(f, str(tmp_path / "t"))
    assert sinks.current(spark, str(tmp_path / "t")).count() == 2 and version.startswith("v-")
    text = spark.createDataFrame([(1, "from 10.0.0.1 to 8.8.8.8 and 10.0.0.12, again 10.0.0.1")], "id long, text string")
    out, tokens = redact.redacted(text)
    assert out.first().text == "from HOST_1 to 8.8.8.8 and HOST_2, again HOST_1"
    assert redact.restored(out, tokens).first().text == text.first().text


def test_streams_equal_the_batch(spark, tmp_path):
    df = conn(spark, steady(50)).repartition(1)
    df.write.parquet(str(tmp_path / "in"))
    for name, made in (("gaps", lambda s: stream.intervals(s)), ("first", lambda s: stream.first_seen(stream.with_time(s), ["src", "dst"]))):
        q = made(stream.arriving(spark, str(tmp_path / "in"), df.schema)).writeStream.format("memory").queryName(f"t_{name}").outputMode("update" if name == "gaps" else "append").option("checkpointLocation", str(tmp_path / f"c_{name}")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    r = spark.table("t_gaps").first()
    assert (r.n, r.mean_iv, round(r.cv, 6)) == (50, 60.0, 0.0)
    assert spark.table("t_first").count() == 1
    seen = []
    stream.merged(stream.arriving(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "c_m"), lambda batch, i: seen.append(batch.count())).awaitTermination(120)
    assert sum(seen) == 50


def test_stale_sources(spark):
    latest = spark.createDataFrame([("a", 10.0), ("b", 95.0)], "sensor string, ts double")
    assert [r.sensor for r in stream.stale(latest, 100.0, 50.0).collect()] == ["a"]
    assert stream.stale(latest, 100.0, 50.0, latest).count() == 0


@pytest.mark.parametrize(
    "ip,cidr,want",
    [
        ("2001:db8::1", "2001:db8::/32", True),
        ("2001:db9::1", "2001:db8::/32", False),
        ("2001:0DB8:0:0::5", "2001:db8::/126", False),
        ("2001:db8::3", "2001:db8::/126", True),
        ("::1", "::1/128", True),
        ("fe80::1%eth0", "fe80::/10", True),
        ("::ffff:10.1.2.3", "2001:db8::/32", False),
        ("10.1.2.3", "10.0.0.0/8", True),
        ("10.1.2.3", "2001:db8::/32", False),
        ("not an address", "::/0", False),
        ("1:2:3", "::/0", False),
    ],
)
def test_ranges_of_both_families(spark, ip, cidr, want):
    assert value(spark, E.in_cidr(F.lit(ip), cidr)) is want
    values, entries = spark.createDataFrame([(ip,)], "ip string"), spark.createDataFrame([(cidr,)], "value string")
    assert (matching.matches(values, "ip", entries).count() == 1) is want


def test_one_address_in_other_spellings(spark):
    values = spark.createDataFrame([(v,) for v in ("2001:DB8:0:0::0:1", "::ffff:10.0.0.1", "10.0.0.2")], "ip string")
    entries = spark.createDataFrame([(v,) for v in ("2001:db8::1", "10.0.0.1", "::ffff:10.0.0.2")], "value string")
    assert {(r.ip, r.value) for r in matching.matches(values, "ip", entries).collect()} == {("2001:DB8:0:0::0:1", "2001:db8::1"), ("::ffff:10.0.0.1", "10.0.0.1"), ("10.0.0.2", "::ffff:10.0.0.2")}


def test_pair_rules_of_all_shapes(spark):
    rows = [(1, "10.0.0.1", "a.evil.com", "443"), (2, "10.0.0.9", "evil.com", "443"), (3, "10.1.0.1", "notevil.com", "443"), (4, "2001:db8::7", "203.0.113.9", "22"), (5, "10.0.0.1", "203.0.113.9", "80")]
    f = spark.createDataFrame([(i, s, d, p, "Beacon", "s0") for i, s, d, p in rows], "id long, src_ip string, dst_ip string, dst_port string, type string, sensor string")
    kinds = "src string, dst string, port string, finding_type string, sensor string"
    hidden = lambda *rules: sorted({1, 2, 3, 4, 5} - {r.id for r in matching.hide_pairs(f, spark.createDataFrame(list(rules), kinds)).collect()})
    assert hidden(("10.0.0.0/29", "*.evil.com", "443", None, None)) == [1]
    assert hidden(("", "*.evil.com", "443", "Beacon", "")) == [1, 2]
    assert hidden(("2001:db8::/64", "203.0.113.0/24", "22", "", "s0"), ("10.0.0.1", "203.0.113.9", "80", "", "")) == [4, 5]
    assert hidden(("bad/99x", "203.0.113.9", "80", "", ""), ("", "203.0.113.9", "80", "Strobe", "")) == []


def test_http_and_dns_beacons(spark):
    web = [(T0 + i * 60.0, "s0", f"W{i}", "10.0.0.5", "203.0.113.9", 80, "c2.example.net", "/poll") for i in range(200)] + [(T0 + i * 61.0, "s0", f"X{i}", "10.0.0.6", "203.0.113.9", 80, "c2.example.net", f"/p{i}") for i in range(40)]
    df = spark.createDataFrame(web, "ts double, sensor string, uid string, src string, dst string, port int, host string, uri string")
    got = beacon.http_beacons(df).collect()
    assert [(r.src_ip, r.host, r.uri, r.n, r.type) for r in got] == [("10.0.0.5", "c2.example.net", "/poll", 200, "HTTP Beacon")] and got[0].detail.startswith("Requests: 200 | Host: c2.example.net | URI: /poll | Score: ts=1.00")
    queries = [(T0 + i * 300.0, "s0", "10.0.0.5", "10.0.0.53", "beat.example.org", "NOERROR") for i in range(60)] + [(T0 + i * 300.0, "s0", "10.0.0.5", "10.0.0.53", "x.cloudfront.net", "NOERROR") for i in range(60)] + [(T0 + i * 300.0, "s0", "10.0.0.7", "10.0.0.53", "few.example.com", "NOERROR") for i in range(19)]
    dns = spark.createDataFrame(queries, "ts double, sensor string, src string, resolver string, query string, rcode string")
    assert [(r.src, r.apex, r.n) for r in beacon.dns_beacons(dns).collect()] == [("10.0.0.5", "example.org", 60)]
    assert beacon.dns_beacons(dns, allowed=spark.createDataFrame([("*.org",)], "value string")).count() == 0


def test_weak_timing_gets_a_hint_and_no_score(spark):
    draw = random.Random(4)
    rows, t = [], T0
    for i in range(300):  # a steady period, seen at random
        if draw.random() < 0.3:
            rows.append((T0 + i * 300 + draw.uniform(0, 110), "10.0.0.5", "203.0.113.9", 443, "ssl", draw.uniform(1, 1e6), 1.0, 1.0))
    df = conn(spark, rows)
    plain = beacon.scored(beacon.profile(df)).first()
    r = beacon.scored(beacon.annotated(beacon.profile(df).withColumn("ts_score", F.lit(0.1)), df)).first()
    assert r.spectral_rescued and abs(r.spectral_period - 300) < 3 and plain.ts_score >= 0
    assert not beacon.annotated(beacon.profile(df).withColumn("ts_score", F.lit(0.9)), df).first().spectral_rescued


def test_busy_keys_are_dealt_out(spark):
    """Blocks of time and sampled series leave counts and intervals as they are."""
    df = conn(spark, steady(300, 7200.0))
    one, two = (sorted((r.ts, r.iv) for r in x.select("ts", "iv").collect() if r.iv is not None) for x in (stats.blocked(df, ["src"]), stats.intervals(df, ["src"])))
    assert one == two
    p = beacon.profile(df, cfg=Config(series_sample=50)).first()
    assert (p.n, p.mean_iv, p.median_iv, p.ts_raw) == (300, 7200.0, 7200.0, 1.0)


def test_run_merge_translates_correlations_and_takes_over_older_names(spark):
    kind = "id long, type string, severity string, score int, src_ip string, dst_ip string, dst_port string, detail string, timestamp string, sensor string, status string, analyst string, analyst_note string, detected_at string, is_new boolean, hostname string, uri string, correlations array<long>"
    row = lambda i, t, sensor, status, host, refs: (i, t, "HIGH", 70, "10.0.0.1", "203.0.113.1", "443", "d", "2024-01-01 00:00:00", sensor, status, "", "", "2024-01-01 00:00:00", False, host, None, refs)
    old = spark.createDataFrame([row(7, "HTTP Beacon", "", "acknowledged", None, None), row(8, "Strobe", "s0", "", None, None)], kind)
    run = spark.createDataFrame([row(1, "HTTP Beacon", "s0", "", "c2.net", [2, -8, 99]), row(2, "C2 Port", "s0", "", None, [1, 3]), row(3, "C2 Port", "s0", "", None, None)], kind)
    got = {r.type: (r.id, r.status, r.is_new, r.correlations) for r in merge.merge_run(old, run, "2024-01-02 00:00:00").collect()}
    assert got == {"HTTP Beacon": (7, "acknowledged", False, [9, 8]), "C2 Port": (9, "", True, [7, 9]), "Strobe": (8, "", False, None)}


def test_streams_match_ranges_and_forget_idle_pairs(spark, tmp_path):
    df = conn(spark, steady(3) + [(T0, "10.0.0.5", "2001:db8::9", 443, "ssl", 1.0, 1.0, 1.0)]).repartition(1)
    df.write.parquet(str(tmp_path / "in"))
    entries = spark.createDataFrame([("203.0.113.0/24", "f", 90), ("2001:db8::/32", "f", 91), ("198.51.100.1", "f", 92)], "value string, feed string, score int")
    q = stream.matched(stream.arriving(spark, str(tmp_path / "in"), df.schema), entries).writeStream.format("memory").queryName("t_hits").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.dst, r.score) for r in spark.table("t_hits").collect()) == [("2001:db8::9", 91)] + [("203.0.113.9", 90)] * 3
    q = stream.intervals(stream.with_time(stream.arriving(spark, str(tmp_path / "in"), df.schema))).writeStream.format("memory").queryName("t_idle").outputMode("update").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.dst: r.n for r in spark.table("t_idle").collect()} == {"203.0.113.9": 3, "2001:db8::9": 1}
