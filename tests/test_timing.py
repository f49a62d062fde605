"""What rests on a profile is over all records of a busy key: the bound of a sample changes nothing."""

import random

import pytest

from packetloom.config import Config
from packetloom.functions import exprs as E
from packetloom.operators import beacon, reports
from tests.test_operators import T0, conn

MANY = Config(beacon_min_score=1, dns_beacon_min_queries=6, unique_subdomain_min=500)
FEW = Config(series_sample=20, beacon_min_score=1, dns_beacon_min_queries=6, unique_subdomain_min=500)


@pytest.fixture(scope="module")
def irregular(spark):
    draw, rows = random.Random(12), []
    for k in range(8):
        at = T0
        for _ in range(120):
            at += draw.choice([60.0, 600.0 + 50 * k, 4000.0]) * draw.uniform(0.6, 1.4)
            rows.append((at, "10.0.0.5", f"203.0.113.{k}", 443, "ssl", draw.lognormvariate(5, 1), 1.0, 1.0))
    return conn(spark, rows)


def said(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_channels_are_over_all_records(spark, irregular):
    ssl = irregular.selectExpr("uid", "CASE WHEN cast(substr(uid, 2) AS int) % 3 = 0 THEN 'a' ELSE 'b' END AS ja3")
    blend = irregular.selectExpr("sensor", "src", "dst", "'Beacon' AS type", "0 AS score").distinct()
    found = lambda cfg: said(beacon.channels(irregular, ssl, blend, cfg).select("dst", "channel", "n", "score", "median_iv", "ts_score", "ds_score"))
    assert len(found(MANY)) == 16 and found(FEW) == found(MANY)


def test_findings_are_over_all_records(irregular):
    found = lambda cfg: said(beacon.findings(beacon.scored(beacon.profile(irregular, cfg=cfg)), cfg=cfg).select("dst", "score", "severity", "detail"))
    assert len(found(MANY)) == 8 and found(FEW) == found(MANY)


def test_dns_beacons_are_over_all_records(irregular):
    dns = irregular.selectExpr("ts", "sensor", "src", "'10.0.0.53' AS resolver", "concat('n', dst, '.e', substr(dst, -1), '.org') AS query", "'NOERROR' AS rcode")
    found = lambda cfg: said(beacon.dns_beacons(dns, cfg).select("apex", "score", "n", "n_subs", "median_iv", "ts_score", "detail"))
    assert len(found(MANY)) == 8 and found(FEW) == found(MANY)


def test_timing_layers_are_over_all_records(irregular):
    found = lambda cfg: said(reports.timing_layers(beacon.scored(beacon.profile(irregular, cfg=cfg)).withColumn("severity", E.beacon_severity("score"))))
    assert found(FEW) == found(MANY)


def test_tls_is_looked_for_in_all_connections(spark):
    links = conn(spark, [(T0 + i * 60, "10.0.0.5", "203.0.113.9", 443, "ssl", 1.0, 1.0, 1.0) for i in range(60)])
    ssl = links.selectExpr("uid", "ts", "CASE WHEN uid IN ('C40', 'C50') THEN uid ELSE '' END AS server_name", "CASE WHEN uid IN ('C45', 'C55') THEN uid END AS ja3", "concat('4-', uid) AS ja4")
    r = beacon.with_tls(links.select("sensor", "src", "dst").distinct(), links, ssl).first()
    assert (r.hostname, r.ja3, r.ja4) == ("C40", "C45", "4-C45")
