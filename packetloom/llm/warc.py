"""WARC archives in Zstandard: one frame per record behind a leading skippable frame with the dictionary.

``write_archives`` puts rows into archives of bounded size, each task its own, under names that a
repeated task writes again; a file gets its name only when it is whole. ``read_archives`` reads any
folder of such archives through Spark's binary file source: it loads the dictionary from the leading
skippable frame, decodes one frame per record, and checks magic numbers, frame and dictionary ids,
header syntax, declared lengths and digests. Anything amiss raises ``ArchiveError``.

Cases: a null payload is empty; a null URL leaves the header out, and control characters in it are
percent-encoded; payloads of any length make one record, alone in its archive where it is larger than
the archive size; equal payloads of at least ``least`` bytes are stored once, in the response of the
smallest page_id (every row that repeats that page_id and payload is a response), the others revisit
it; an empty table gives no archive and no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from hashlib import sha256
from urllib.parse import quote
from uuid import uuid4

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.io import shared_dir

#: Fixed values of the formats: skippable frame that holds a dictionary, Zstandard frame, dictionary.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437

#: Payload bytes of an archive, and bytes of samples that its dictionary is made from.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 8 << 20, 1 << 20, 16 << 10

RECORDS = "record_id string, record_type string, refers_to string, uri string, payload_bytes long, payload_digest string, payload binary"


class ArchiveError(ValueError):
    """An archive, frame or record that is not well formed."""


def record(record_id: str, uri: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One WARC/1.1 record: a response with its payload, or a revisit with the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    head = {
        "WARC-Type": "revisit" if refers_to else "response",
        "WARC-Record-ID": f"<{record_id}>",
        "WARC-Date": date,
        "WARC-Target-URI": None if uri is None else quote(uri, safe=":/?#[]@!$&'()*+,;=%~-._"),
        "WARC-Refers-To": f"<{refers_to}>" if refers_to else None,
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if refers_to else None,
        "WARC-Payload-Digest": f"sha256:{sha256(payload).hexdigest()}",
        "WARC-Block-Digest": f"sha256:{sha256(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def make_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from a bounded part of an archive's records; raw content where they are too few to train on."""
    few, size = [], 0
    for s in samples:
        few.append(s[: SAMPLE_BYTES // 16])
        size += len(few[-1])
        if size >= SAMPLE_BYTES:
            break
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, few).as_bytes()
    except zstandard.ZstdError:
        return b"".join(few)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\n"


def archive(records: list[bytes]) -> bytes:
    made = make_dictionary(records)
    raw = struct.unpack("<I", made[:4].ljust(4, b"\0"))[0] != DICTIONARY
    entry = zstandard.ZstdCompressionDict(made, dict_type=zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT)
    with_it = zstandard.ZstdCompressor(level=3, dict_data=entry, write_checksum=True, write_content_size=True)
    packed = zstandard.ZstdCompressor(level=3).compress(made)  # the dictionary may be compressed itself
    lead = struct.pack("<II", SKIPPABLE, len(packed)) + packed
    return lead + b"".join(map(with_it.compress, records))


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one frame each."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != SKIPPABLE:
        raise ArchiveError("no leading skippable frame")
    (size,) = struct.unpack_from("<I", data, 4)
    if 8 + size > len(data):
        raise ArchiveError("the dictionary's frame is cut short")
    made = data[8 : 8 + size]
    if made[:4] == struct.pack("<I", FRAME):
        made = zstandard.ZstdDecompressor().decompress(made)
    raw = made[:4] != struct.pack("<I", DICTIONARY)
    entry = zstandard.ZstdCompressionDict(made, dict_type=zstandard.DICT_TYPE_RAWCONTENT if raw else zstandard.DICT_TYPE_FULLDICT)
    decompressor = zstandard.ZstdDecompressor(dict_data=entry)
    view, at = memoryview(data), 8 + size
    while at < len(data):
        if bytes(view[at : at + 4]) != struct.pack("<I", FRAME):
            raise ArchiveError(f"no frame at byte {at}")
        try:
            said = zstandard.get_frame_parameters(view[at : at + 18])
            if said.dict_id not in (0, entry.dict_id()):
                raise ArchiveError(f"the frame at byte {at} names another dictionary")
            step, out, feed = decompressor.decompressobj(), [], at
            while not step.eof:
                if feed >= len(data):
                    raise ArchiveError(f"the frame at byte {at} is cut short")
                piece = view[feed : feed + (1 << 16)]
                out.append(step.decompress(piece))
                feed += len(piece)
            feed -= len(step.unused_data)
        except zstandard.ZstdError as e:
            raise ArchiveError(f"the frame at byte {at}: {e}") from e
        whole = b"".join(out)
        if said.content_size not in (zstandard.CONTENTSIZE_UNKNOWN, len(whole)):
            raise ArchiveError(f"the frame at byte {at} has {len(whole)} bytes and declares {said.content_size}")
        yield whole
        at = feed


def _headers(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ArchiveError(f"malformed header {line[:80]!r}")
        out[name.lower()] = value.strip()
    return out


def _length(head: dict[str, str]) -> int:
    if not head.get("content-length", "").isdigit():
        raise ArchiveError("no valid Content-Length")
    return int(head["content-length"])


def parse(raw: bytes) -> dict:
    """A record's fields, after its headers, lengths and digests are checked."""
    version, _, rest = raw.partition(b"\r\n")
    if version != b"WARC/1.1":
        raise ArchiveError(f"no WARC/1.1 record: {version[:20]!r}")
    lines, gap, rest = rest.partition(b"\r\n\r\n")
    head = _headers(lines)
    if missing := [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in head] + ([] if gap else ["end"]):
        raise ArchiveError(f"headers without {', '.join(missing)}")
    block, tail = rest[: (n := _length(head))], rest[n:]
    if len(block) != n or tail != b"\r\n\r\n":
        raise ArchiveError("Content-Length does not end at the record's end")
    if f"sha256:{sha256(block).hexdigest()}" != head.get("warc-block-digest", "").lower():
        raise ArchiveError("the block does not have its digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = _length(_headers(http.partition(b"\r\n")[2]))
    digest = head.get("warc-payload-digest", "").lower().removeprefix("sha256:")
    kind = head["warc-type"]
    if kind == "response" and (len(payload) != size or sha256(payload).hexdigest() != digest):
        raise ArchiveError("the payload does not have its length or digest")
    if kind == "revisit" and (payload or "warc-refers-to" not in head):
        raise ArchiveError("a revisit has a payload or refers to nothing")
    return {
        "record_id": head["warc-record-id"].strip("<>"),
        "record_type": kind,
        "refers_to": head["warc-refers-to"].strip("<>") if "warc-refers-to" in head else None,
        "uri": head.get("warc-target-uri"),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": None if kind == "revisit" else payload,
    }


def put(uri: str, data: bytes) -> None:
    """A file with its last name only when it is whole, in any file system that Arrow knows."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    draft = f"{folder}/_{name}.{uuid4().hex}"
    with store.open_output_stream(draft) as out:
        out.write(data)
    store.move(draft, path)


def write_archives(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Archives of (record_id, uri, payload, refers_to) rows in folder; returns the number of records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal count, held, size
            put(f"{folder}/part-{part:06d}-{count:06d}.warc.zst", archive(held))
            out = pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], names=["records"])
            count, held, size = count + 1, [], 0
            return out

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                held.append(record(row["record_id"], row["uri"], row["payload"] or b"", row["refers_to"], date))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
        if held:
            yield flush()

    read = rows.select("record_id", "uri", F.col("payload").cast("binary").alias("payload"), "refers_to")
    return read.mapInArrow(run, "records long").agg(F.sum("records")).first()[0] or 0


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of all archives in folder, checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                held, size = [], 0
                for raw in frames(data.as_py()):
                    held.append(parse(raw))
                    if not payload:
                        held[-1]["payload"] = None
                    size += len(held[-1]["payload"] or b"") + 200
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in RECORDS.split(", "))])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select("content").mapInArrow(run, RECORDS)


def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """Pages as (record_id, uri, payload, refers_to): the first of equal payloads is named by the others.

    Only digests meet to find equal payloads; the payloads themselves move once, dealt by page.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha2("payload", 256))
    large = rows.filter(F.octet_length("payload") >= least).select("page_id", "digest")
    groups = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = large.join(groups, "digest").filter(~F.col("page_id").eqNullSafe(F.col("first"))).distinct()
    later = later.select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first")
    joined = rows.join(later, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    return joined.select("page_id", name("page_id").alias("record_id"), F.col("url").alias("uri"), "payload", F.when(F.col("first").isNotNull(), name("first")).alias("refers_to"))


def round_trip(pages: DataFrame, least: int = 100) -> DataFrame:
    """Pages written as archives to the shared folder and read back: one row per record."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/packetloom/warc-{uuid4().hex}"
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    if not write_archives(with_revisits(pages, least).sortWithinPartitions("page_id"), folder):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_archives(spark, folder, payload=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )
