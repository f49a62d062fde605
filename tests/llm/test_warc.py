import os
from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.errors import PythonException

from packetloom.llm import warc

SF = "/root/testdata/sf0.001"


def brute(rows, least=100):
    groups = defaultdict(list)
    for r in rows:
        groups[(r.html or "").encode()].append(r.page_id)
    out = []
    for r in rows:
        data = (r.html or "").encode()
        first = min((p for p in groups[data] if p is not None), default=None)
        later = len(data) >= least and r.page_id != first and first is not None
        out.append((r.page_id, len(data), sha256(data).hexdigest(), "revisit" if later else "response", first if later else None))
    return sorted(out, key=str)


def test_pages_and_odd_rows(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    copies = [(1000 + i, "http://x/\r\nb ä", "same " * 100) for i in range(30)]
    odd = [(None, None, None), (None, "u", "z" * 200), (5, "u", "z" * 200), (5, "u", "z" * 200), (6, "", ""), (7, "u", "ü" * 300_000), (8, "u", "q" * 99), (9, "u", "q" * 99)]
    for df in (pages, spark.createDataFrame(copies + odd, "page_id long, url string, html string")):
        assert sorted((tuple(r) for r in warc.round_trip(df).collect()), key=str) == brute(df.collect())
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_payloads_come_back(spark, tmp_path):
    rows = [(f"urn:page:{i}", f"http://h/{i}", bytes([i % 251]) * (i * 37), None) for i in range(200)]
    df = spark.createDataFrame(rows, "record_id string, uri string, payload binary, refers_to string")
    assert warc.write_archives(df, str(tmp_path / "a"), archive_bytes=50_000) == 200
    got = {r.record_id: (r.uri, bytes(r.payload)) for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    assert got == {r[0]: (r[1], r[2]) for r in rows}
    assert not [f for f in os.listdir(tmp_path / "a") if f.startswith("_") or f.startswith(".") and "crc" not in f]


def records():
    return [warc.record(f"urn:page:{i}", "http://h/", b"body %d" % i * 50, None, "2024-01-01T00:00:00Z") for i in range(20)]


def test_one_frame_per_record_behind_the_dictionary():
    data = warc.archive(records())
    assert data[:4] == warc.SKIPPABLE.to_bytes(4, "little")
    assert list(warc.frames(data)) == records()


@pytest.mark.parametrize("few", [1, 2])
def test_too_few_samples_to_train_on(few):
    assert list(warc.frames(warc.archive(records()[:few]))) == records()[:few]


@pytest.mark.parametrize(
    "spoil",
    [
        lambda d: d[8:],
        lambda d: d[:-3],
        lambda d: d[:6],
        lambda d: d + b"rubbish",
        lambda d: d[:-20] + bytes(x ^ 255 for x in d[-20:-10]) + d[-10:],
    ],
)
def test_spoilt_archives_are_refused(spoil):
    with pytest.raises(warc.ArchiveError):
        list(warc.frames(spoil(warc.archive(records()))))


@pytest.mark.parametrize(
    "change",
    [
        (b"WARC/1.1", b"WARC/9.9"),
        (b"Content-Length: ", b"Content-Length: 1"),
        (b"Content-Length: ", b"Content-Length: x"),
        (b"WARC-Type: ", b"WARC Type: "),
        (b"WARC-Date: ", b"WARC-When: "),
        (b"body 1", b"bodx 1"),
        (b"WARC-Payload-Digest: sha256:", b"WARC-Payload-Digest: sha256:0"),
    ],
)
def test_spoilt_records_are_refused(change):
    raw = records()[1]
    assert warc.parse(raw)["record_type"] == "response"
    with pytest.raises(warc.ArchiveError):
        warc.parse(raw.replace(*change, 1))


def test_a_spoilt_file_fails_the_read(spark, tmp_path):
    (tmp_path / "x.warc.zst").write_bytes(warc.archive(records())[:-5])
    with pytest.raises(PythonException):
        warc.read_archives(spark, str(tmp_path)).collect()
