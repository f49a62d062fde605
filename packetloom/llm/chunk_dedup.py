"""Exact dedup by content-defined chunk recipes.

A text, with white space deleted, is cut where a rolling hash of its last bytes meets a condition, so
equal passages give equal chunks wherever they lie. A document becomes a recipe: the ordered
identifiers of its chunks. Documents are equal exactly if their recipes are, so only short lists are
grouped and compared; a chunk's bytes travel once per task and content, however many documents hold
them.

An identifier starts as a 64-bit hash and is verified: contents with one hash are compared byte by
byte, and where they differ each content gets its own ordinal, which then is part of the identifier.

Cases: a null text counts as empty, and all empty texts (no chunk) are equal; texts of any length are
read whole in blocks; of equal texts the one with the most code points in the original stays, then the
smallest doc_id (a null doc_id last), and of wholly repeated rows exactly one; an empty table gives no
rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.io import written

WHITE = b" \t\n\x0b\x0c\r"

#: Bytes of a chunk, and of the window that decides where it ends.
LEAST, MOST, WINDOW, MASK_BITS, BLOCK = 2048, 16384, 32, 11, 1 << 16

_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def _powers(x: int, n: int) -> np.ndarray:
    """1, x, x², ... modulo 2^64."""
    out = np.full(n, x, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_FACTOR, BLOCK + WINDOW + 1), _powers(_INVERSE, BLOCK + WINDOW + 1)
_SPREAD = _powers(0xD6E8FEB86659FD93, 257)[1:]


def chunks(data: bytes) -> list[bytes]:
    """The content-defined chunks of data; none for no data."""
    if len(data) <= LEAST:
        return [data] if data else []
    ends = np.concatenate([_candidates(data, at) for at in range(0, len(data), BLOCK)])
    out, at, i = [], 0, 0
    while at < len(data):
        i = int(np.searchsorted(ends, at + LEAST))
        end = int(ends[i]) if i < len(ends) else len(data)
        end = min(end, at + MOST, len(data))
        out.append(data[at:end])
        at = end
    return out


def _candidates(data: bytes, at: int) -> np.ndarray:
    """Where a chunk may end, in (at, at + BLOCK]: the polynomial hash of the WINDOW bytes before it fits."""
    first = max(0, at - WINDOW)
    seen = _SPREAD[np.frombuffer(data[first : at + BLOCK], np.uint8)]
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(seen * _DOWN[: len(seen)], dtype=np.uint64)])
    if len(total) <= WINDOW:
        return np.zeros(0, np.int64)
    rolled = (total[WINDOW:] - total[:-WINDOW]) * _UP[: len(total) - WINDOW]
    ends = np.flatnonzero(rolled >> np.uint64(64 - MASK_BITS) == 0) + first + WINDOW
    return ends[ends > at]


def _normal(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(None, WHITE)


def _id(chunk: bytes, bits: int) -> int:
    h = xxhash.xxh3_64_intdigest(chunk) >> (64 - bits)
    return h - (1 << 64) if h >> 63 else h


def recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """One row per document: an own row id, sizes, the digest of its normalised text, and its recipe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column("text").to_pylist()
                flat, sizes, digests = [], [], []
                for t in texts:
                    data = _normal(t)
                    own = [_id(c, bits) for c in chunks(data)]
                    flat += own
                    sizes.append(len(own))
                    digests.append(sha256(data).hexdigest())
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(range(row, row + n), pa.int64()),
                        part.column("doc_id"),
                        pa.array([len(t or "") for t in texts], pa.int64()),
                        pa.array(digests),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64())),
                    ],
                    names=["rid", "doc_id", "n_chars", "text_sha256", "recipe"],
                )
                row += n

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return read.mapInArrow(run, "rid long, doc_id long, n_chars long, text_sha256 string, recipe array<long>")


def contents(docs: DataFrame, bits: int = 64) -> DataFrame:
    """The chunks' bytes: (text_sha256, place, chunk, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows: list[tuple] = []
                for t in batch.column("text").slice(at, 500).to_pylist():
                    data = _normal(t)
                    digest = sha256(data).digest()
                    rows += [(digest, i, _id(c, bits), c) for i, c in enumerate(chunks(data))]
                columns = zip(*rows) if rows else [[]] * 4
                kinds = (pa.binary(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["text", "place", "chunk", "content"])

    return docs.select("text").mapInArrow(run, "text binary, place int, chunk long, content binary")


def ambiguous(docs: DataFrame, bits: int = 64) -> DataFrame:
    """The identifiers that stand for more than one content."""
    stored = contents(docs, bits).groupBy("chunk", "content").agg(F.count("*").alias("uses"))
    return stored.groupBy("chunk").agg(F.count("*").alias("contents")).filter("contents > 1").select("chunk")


def dedup(docs: DataFrame, bits: int = 64) -> DataFrame:
    """One row per document: which row stays for it, its group's size, whether it stays, its text's digest."""
    rows = written(recipes(docs, bits), "recipes")
    unclear = written(ambiguous(docs, bits), "ambiguous")
    key = ["recipe"]
    if not unclear.isEmpty():
        # A place of an ambiguous identifier is told apart by the ordinal of its content.
        held = contents(docs, bits).join(unclear, "chunk", "left_semi").distinct()
        order = Window.partitionBy("chunk").orderBy("content")
        named = held.select("chunk", "content").distinct().withColumn("ordinal", F.row_number().over(order))
        told = held.join(named, ["chunk", "content"]).groupBy(F.lower(F.hex("text")).alias("text_sha256"))
        rows = rows.join(told.agg(F.array_sort(F.collect_list(F.struct("place", "ordinal"))).alias("told")), "text_sha256", "left")
        rows = rows.withColumn("told", F.coalesce(F.to_json("told"), F.lit("")))
        key = ["recipe", "told"]
    best = F.min(F.struct((-F.col("n_chars")).alias("c"), F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    # Written, so that the join below deals out its own rows and a large group can be split among tasks.
    groups = written(rows.groupBy(*key).agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    return rows.join(groups, key).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        "text_sha256",
    )
