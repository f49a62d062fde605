"""Evidence: a log without names is numbered once for findings of addresses and of names."""

from packetloom.operators import matching


def test_a_log_without_names_is_numbered_once(spark, monkeypatch):
    calls, nearest = [], matching._nearest
    monkeypatch.setattr(matching, "_nearest", lambda *args: calls.append(1) or nearest(*args))
    records = spark.createDataFrame([("C1", "10.0.0.1", "203.0.113.9", 5.0), ("C2", "10.0.0.1", "Named.example", 9.0)], "uid string, src string, dst string, ts double")
    findings = spark.createDataFrame([(1, "Beacon", "10.0.0.1", "203.0.113.9", 6.0), (2, "Beacon", "10.0.0.1", "named.example", 6.0)], "id int, type string, src_ip string, dst_ip string, at double")
    got = sorted((r.id, r.uid, r.place) for r in matching.raw_evidence(findings, {"conn": records}).collect())
    assert got == [(1, "C1", 1), (2, "C2", 1)] and len(calls) == 1
