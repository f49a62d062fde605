"""Sources that a beacon's steps read several times are read once, and parsed once a row."""

from packetloom.functions import exprs as E
from packetloom.operators import beacon, detect, matching, stats
from packetloom.plans import queries
from packetloom.plans.views import view

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_on_names_do_not_read_the_field_again(spark):
    rows = detect.dns_rows(view(spark, SF, "dns_v")).filter("rcode != 'NXDOMAIN'")
    assert optimized(rows).count("get_json_object") == 1
    assert optimized(view(spark, SF, "findings_v").filter("type = 'Beacon' AND dst_port = '53'")).count("get_json_object") == 1


def test_apex_of_odd_names(spark):
    said = {"": "", "a": "a", "a.b": "a.b", "x.a.b": "a.b", "CO.uk": "co.uk", "a.co.uk": "a.co.uk", "y.x.Co.UK": "x.co.uk", ".co.uk": ".co.uk", "a.b.": "b.", "..": ".", "a..b": ".b", None: None}
    rows = spark.createDataFrame([(n,) for n in said], "name string")
    assert {r.name: r.apex for r in rows.select("name", E.apex("name").alias("apex")).collect()} == said


def test_a_profile_of_names_reads_what_was_answered(spark):
    assert all("/answered-" in f or "/windows-" in f for f in queries.QUERIES["det_dns_beacon_profile"](spark, SF).inputFiles())


def test_prevalence_reads_its_source_once(spark):
    rows = [("s0", f"h{i}", d) for i in range(12) for d in ("all", f"own{i % 3}") if i or d == "all"] + [("s0", None, "all"), (None, "h1", "all"), ("s1", "h1", None)]
    found = stats.prevalence(spark.createDataFrame(rows * 2, "sensor string, src string, dst string"))
    assert found.inputFiles() and all("/pairs-" in f for f in found.inputFiles())
    assert {(r.sensor, r.dst): (r.dst_srcs, r.all_srcs, r.prevalence_mod) for r in found.collect()} == {("s0", "all"): (12, 12, 0.85), ("s0", "own0"): (3, 12, 1.0), ("s0", "own1"): (4, 12, 1.0), ("s0", "own2"): (4, 12, 1.0), ("s1", None): (1, 1, 1.0)}


def test_scores_are_not_dealt_out_by_destination(spark):
    profiled = spark.createDataFrame([("s0", "h1", "all", *[0.5] * 5)], "sensor string, src string, dst string, ts_score double, ds_score double, hist_score double, dur_score double, conf double")
    rows = spark.createDataFrame([("s0", f"h{i}", "all") for i in range(12)], "sensor string, src string, dst string")
    found = beacon.scored(profiled, stats.prevalence(rows))
    assert "Aggregate" not in optimized(found) and [r.score for r in found.collect()] == [21]


def test_tls_rows_are_sorted_once(spark):
    beacons = spark.createDataFrame([("s0", "h", "d")], "sensor string, src string, dst string")
    links = spark.createDataFrame([("u1", "s0", "h", "d", 1.0), ("u2", "s0", "h", "d", 2.0)], "uid string, sensor string, src string, dst string, ts double")
    ssl = spark.createDataFrame([("u1", 1.0, "old", "a"), ("u1", 5.0, "", "b"), ("u1", None, "none", "c"), ("u2", 2.0, "two", None)], "uid string, ts double, server_name string, ja3 string")
    found = beacon.with_tls(beacons, links, ssl)
    assert "WindowGroupLimit [uid" not in optimized(found)
    assert [(r.hostname, r.ja3) for r in found.collect()] == [("two", "b")]


def test_notes_count_the_resolvers_once(spark):
    found = matching.beacon_notes(queries.at_resolver(spark, SF), detect.resolvers(view(spark, SF, "dns_v")))
    assert "10.0.255.53 AS resolver" not in optimized(found) and any("/resolvers-" in f for f in found.inputFiles())
