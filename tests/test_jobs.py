"""Jobs that may be run again: redaction there and back, retention copies, batches of a stream."""

import pytest
from pyspark.sql import functions as F

from packetloom.sources import archive, logs, redact, sinks
from packetloom.streaming import stream


def test_addresses_and_names_become_tokens_and_come_back(spark):
    texts = [
        (1, "10.0.0.1 asked dc1.corp.local, then 10.0.0.10 and DC1.corp.local. via fe80::1 or ::1; 8.8.8.8, 2001:db8::1"),
        (2, "notcorp.local corp.local.evil.com x.corp.local 300.1.1.1 10.0.0.1.corp.local v1.2.3.4.5 aa:bb"),
        (3, None),
        (4, ""),
        (5, "172.20.1.1:443 and 172.20.1.1 and 198.51.100.7"),
    ]
    df = spark.createDataFrame(texts, "id long, text string")
    domains = spark.createDataFrame([(".Corp.LOCAL.",), ("  ",), ("lab.example",)], "value string")
    out, tokens = redact.redacted(df, ranges=spark.createDataFrame([("198.51.100.7",), ("2001:db8::/32",), ("junk",)], "value string"), domains=domains)
    got = {r.id: r.text for r in out.collect()}
    assert got[1] == "HOST_1 asked HOST_6, then HOST_2 and HOST_7. via HOST_3 or HOST_4; 8.8.8.8, HOST_5"
    assert got[2] == "notcorp.local corp.local.evil.com HOST_2 300.1.1.1 HOST_3 v1.2.3.4.5 aa:bb"
    assert got[3] is None and got[4] == "" and got[5] == "HOST_1:443 and HOST_1 and HOST_2"
    assert {r.id: r.text for r in redact.restored(out, tokens).collect()} == dict(texts)
    assert {r.id: r.text for r in redact.redacted(df)[0].collect()}[2].startswith("notcorp.local corp.local.evil.com x.corp.local")


def test_old_partitions_are_copied_checked_and_resumed(spark, tmp_path):
    for day, name in (("2024-01-01", "conn.log"), ("2024-01-01", "dns.log.gz"), ("2024-01-02", "conn.log"), ("2024-03-01", "conn.log")):
        (at := tmp_path / "logs" / "north" / day).mkdir(parents=True, exist_ok=True)
        (at / name).write_bytes(f"{day} {name}".encode() * 1000)
    source, target = str(tmp_path / "logs"), str(tmp_path / "kept")
    held = lambda: {str(p.relative_to(tmp_path / "kept")): p.read_bytes() for p in (tmp_path / "kept" / "north").rglob("*") if p.is_file()}
    before = {p: p.read_bytes() for p in (tmp_path / "logs").rglob("*.log*")}
    assert archive.copy(spark, source, target, "2024-01-02").count() == 2 and len(held()) == 2
    assert archive.copy(spark, source, target, "2024-02-01").count() == 1  # only what isn't there yet
    assert archive.copy(spark, source, target, "2024-02-01").count() == 0
    assert held() == {str(p.relative_to(tmp_path / "logs")): x for p, x in before.items() if "2024-03" not in str(p)}
    assert {p: p.read_bytes() for p in before} == before and archive.manifest(spark, target).count() == 3
    assert archive.verified(spark, target).filter("NOT whole").count() == 0
    (tmp_path / "kept/north/2024-01-02/conn.log").write_bytes(b"spoilt")
    assert [r.target[-19:] for r in archive.verified(spark, target).filter("NOT whole").collect()] == ["2024-01-02/conn.log"]


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    root, job = str(tmp_path / "table"), "daily"
    sinks.publish(spark.createDataFrame([("a", 1, "Beacon")], "k string, n long, type string"), root)
    spark.createDataFrame([("a", 5, "Beacon"), ("b", 7, "Strobe")], "k string, n long, type string").write.parquet(str(tmp_path / "in"))
    incoming = lambda: stream.arriving(spark, str(tmp_path / "in"), "k string, n long, type string")
    merge = lambda table, batch: table.select("k", "n", "type").union(batch.select("k", "n", "type")).groupBy("k", "type").agg(F.sum("n").alias("n"))
    table = lambda: {(r.k, r.n) for r in sinks.current(spark, root).collect()}

    def crash(table, batch):
        merge(table, batch).count()
        raise RuntimeError("before the version is published")

    with pytest.raises(Exception, match="before the version"):
        stream.upserted(incoming(), str(tmp_path / "c"), root, job, crash).awaitTermination(120)
    assert table() == {("a", 1)}
    stream.upserted(incoming(), str(tmp_path / "c"), root, job, merge).awaitTermination(120)
    assert table() == {("a", 6), ("b", 7)}
    # The same batch once more, as after a crash between publishing and Spark's own commit.
    stream.upserted(incoming(), str(tmp_path / "c2"), root, job, merge).awaitTermination(120)
    assert table() == {("a", 6), ("b", 7)} and sinks.applied(spark, root, job, 0) and not sinks.applied(spark, root, "other", 0)


def test_a_day_of_a_sensor_opens_only_its_files(spark, tmp_path):
    for sensor in ("north", "south"):
        for day in ("2024-01-14", "2024-01-15", "2024-01-16"):
            (at := tmp_path / sensor / day).mkdir(parents=True)
            (at / "conn.log").write_text(f'{{"ts": 1, "uid": "{sensor}{day[-2:]}", "id.orig_h": "10.0.0.1"}}\n')
    got = lambda **part: {r.uid for r in logs.read(spark, str(tmp_path), "conn", part=logs.Part(**part)).collect()}
    files = lambda **part: len(logs._lines(spark, str(tmp_path), "conn", logs.Part(**part)).inputFiles())
    assert got(since="2024-01-15", until="2024-01-15") == {"north15", "south15"} and files(since="2024-01-15", until="2024-01-15") == 2
    assert got(sensors=("south",)) == {"south14", "south15", "south16"}
    assert got(sensors=("south", "west"), since="2024-01-15", until="2024-02-20", spread=4) == {"south15", "south16"}
    assert got(sensors=("west",)) == set() and got(since="2023-01-01", until="2023-01-02") == set()
    with pytest.raises(ValueError):
        got(since="2024-01-15")
