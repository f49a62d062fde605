"""Token-id files in Simple-8b: word-aligned blocks of ids that decode as arrays.

A 64-bit word holds a selector in its top four bits and as many ids as fit into the other 60 (``WIDTHS``):
60 ids of one bit down to one id of 60 bits, always the most that fit next. A larger value is an escape:
its word holds the place of the value in the block's list of whole values, so a block decodes without a
scan, one array operation per selector. A file is a header, a table of documents (id, tokens), a table
of blocks (offset of their words, ids, escapes) and the blocks; any block can be read by itself, and a
checksum covers everything.

``write_files`` deals documents out by ranges of (doc_id, place in the input), so that the files in the
order of their first document hold the ids of the whole corpus in ascending doc_id order (nulls first);
texts move once, ids never. Files have the names of their task and number, which a repeated task writes again, and
get them only when they are whole. The manifest that it returns has one row per file, with the ids of
all files before it. ``read_files`` reads any such folder through Spark's binary file source.

Encoding takes a byte-level vocabulary of the tokenizers library. Texts are cut into the pieces that its
byte-level pre-tokeniser cuts; new pieces are encoded by the library and kept in a bounded memo. Texts
with characters beyond Latin letters go to the library whole.

Cases: a null or empty text is the end id alone; texts of any length are encoded whole, a document never
spans two files, and a file is as long as its longest document at least; a null doc_id comes before all
others; rows that repeat a doc_id follow one another in the order of the input; an empty table gives no
file and no rows. Extra columns are not read.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.llm.bpe import spec_of
from packetloom.llm.io import shared_dir, written
from packetloom.llm.warc import put

#: Ids in a word and bits of each, by selector; selector 0 is an escape.
WIDTHS = {1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7), 8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60)}

#: Ids of a block, and ids after which a file ends with its document.
BLOCK, FILE_IDS = 1 << 16, 1 << 23

MAGIC, VERSION = b"S8BT", 1
_HEAD = struct.Struct("<4sIQQQI")
_LOW60 = np.uint64((1 << 60) - 1)

#: Pieces kept encoded, and characters of text that are cut into pieces at once.
MEMO_PIECES, CHUNK_CHARS = 1_000_000, 1 << 21
#: Pieces that are encoded in one text, and the stand-in of a space in byte-level tokens (a fixed value).
JOINED, _SPACE_SYMBOL = 64, "\u0120"

#: Bits of small values, at least one.
_BITS = np.concatenate([[1], np.repeat(np.arange(1, 17), 1 << np.arange(16))]).astype(np.uint8)


class FileError(ValueError):
    """A token file that is not well formed."""


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of one block of unsigned values, and the whole values that its escapes stand for."""
    values = values.astype(np.uint64, copy=False)
    n = len(values)
    bits = np.ones(n + 60, np.uint8)
    bits[n:] = 255  # no word reaches beyond the block
    if n and int(values.max()) < len(_BITS):
        bits[:n] = _BITS[values]
    else:
        left = values.copy()
        for shift in (32, 16, 8, 4, 2, 1):
            over = left >> np.uint64(shift) > 0
            bits[:n][over] += shift
            left[over] >>= np.uint64(shift)
    widest = {1: bits}  # the most bits among so many neighbours from each place on
    for k in (2, 4, 8, 16, 32):
        half = widest[k // 2]
        widest[k] = np.maximum(half[: n + 60 - k + 1], half[k // 2 : k // 2 + n + 60 - k + 1])
    chosen = np.zeros(n, np.uint8)
    for selector in sorted(WIDTHS, reverse=True):
        count, width = WIDTHS[selector]
        k = 1 << (count.bit_length() - 1)
        most = np.maximum(widest[k][:n], widest[k][count - k : count - k + n])
        chosen[most <= width] = selector
    step = np.array([1, *(WIDTHS[s][0] for s in range(1, 15))])[chosen].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    first = np.array(starts, np.int64)
    selectors = chosen[first]
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector, (count, width) in WIDTHS.items():
        here = np.flatnonzero(selectors == selector)
        for i in range(count) if len(here) else ():
            words[here] |= values[first[here] + i] << np.uint64(i * width)
    escaped = np.flatnonzero(selectors == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    return words, values[first[escaped]]


def unpack(words: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The values of one block."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    if len(words) and selectors.max() > 14:
        raise FileError("a word has no valid selector")
    counts = np.array([1, *(WIDTHS[s][0] for s in range(1, 15))])[selectors]
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    first = ends - counts
    for selector, (count, width) in WIDTHS.items():
        here = np.flatnonzero(selectors == selector)
        held, to, mask = words[here], first[here], np.uint64((1 << width) - 1)
        for i in range(count) if len(here) else ():
            out[to + i] = held >> np.uint64(i * width) & mask
    escaped = np.flatnonzero(selectors == 0)
    if len(escaped):
        if int(words[escaped].max()) >= len(whole):
            raise FileError("an escape points beyond its block's values")
        out[first[escaped]] = whole[words[escaped].astype(np.int64)]
    return out


class Writer:
    """One file's ids, packed block by block as they come."""

    def __init__(self, block: int = BLOCK) -> None:
        self.block, self.docs, self.lengths = block, [], []
        self.ids, self.tables, self.body, self.words = 0, [], [], 0
        self._held: list[np.ndarray] = []
        self._size = 0

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.lengths.append(len(ids))
        self.ids += len(ids)
        self._held.append(ids)
        self._size += len(ids)
        if self._size >= self.block:
            self._pack(False)

    def _pack(self, last: bool) -> None:
        held = np.concatenate(self._held) if self._held else np.zeros(0, np.uint32)
        whole = len(held) if last else len(held) // self.block * self.block
        for at in range(0, whole, self.block):
            words, values = pack(held[at : min(at + self.block, whole)])
            self.tables.append((self.words, min(self.block, whole - at), len(values)))
            self.body += [words.tobytes(), values.tobytes()]
            self.words += len(words) + len(values)
        self._held, self._size = [held[whole:]], len(held) - whole

    def data(self) -> bytes:
        self._pack(True)
        docs = np.array([(d or 0, d is None, n) for d, n in zip(self.docs, self.lengths)], np.int64).reshape(-1, 3)
        rest = b"".join([docs.astype("<i8").tobytes(), np.array(self.tables, "<u8").tobytes(), *self.body])
        return _HEAD.pack(MAGIC, VERSION, self.ids, len(docs), len(self.tables), crc32(rest)) + rest


class Reader:
    """A file's documents and blocks, after its header, sizes and checksum are checked."""

    def __init__(self, data: bytes) -> None:
        if len(data) < _HEAD.size:
            raise FileError("no header")
        magic, version, self.ids, docs, blocks, check = _HEAD.unpack_from(data)
        if (magic, version) != (MAGIC, VERSION):
            raise FileError("another format or version")
        at = _HEAD.size + 24 * (docs + blocks)
        if at > len(data) or (len(data) - at) % 8:
            raise FileError("the file is cut short")
        if crc32(memoryview(data)[_HEAD.size :]) != check:
            raise FileError("the file does not have its checksum")
        self.docs = np.frombuffer(data, "<i8", 3 * docs, _HEAD.size).reshape(-1, 3)
        self.tables = np.frombuffer(data, "<u8", 3 * blocks, _HEAD.size + 24 * docs).reshape(-1, 3).astype(np.int64)
        self.body = np.frombuffer(data, "<u8", -1, at)
        if self.ids != self.docs[:, 2].sum() or self.ids != self.tables[:, 1].sum():
            raise FileError("documents, blocks and header don't have the same number of ids")

    def block(self, k: int) -> np.ndarray:
        """The ids of block k, whatever the others are."""
        start, ids, escapes = self.tables[k].tolist()
        end = int(self.tables[k + 1, 0]) if k + 1 < len(self.tables) else len(self.body)
        out = unpack(self.body[start : end - escapes], self.body[end - escapes : end])
        if len(out) != ids:
            raise FileError(f"block {k} holds {len(out)} ids and declares {ids}")
        return out

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the file, ids), holding no more than a document and a block."""
        held, k, start = np.zeros(0, np.uint32), 0, 0
        for doc, null, n in self.docs.tolist():
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.block(k).astype(np.uint32))
                have, k = have + len(parts[-1]), k + 1
            joined = np.concatenate(parts) if len(parts) > 1 else held
            yield None if null else doc, start, joined[:n]
            held, start = joined[n:], start + n


#: The pieces of byte-level vocabularies in ASCII and in Latin texts, letters, digits and spaces spelt out.
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[a-zA-Z]+| ?[0-9]+| ?[^\sa-zA-Z0-9]+|\s+(?!\S)|\s+", re.ASCII)
_LETTER, _NUMBER, _SPACE = "a-zA-ZªµºÀ-ÖØ-öø-ž", "0-9²³¹¼-¾", "\\x09-\\x0d\\x20\u0085 "
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_PLAIN = re.compile(r"[\x00-ž]*\Z")


class Encoder:
    """A byte-level vocabulary of the tokenizers library, with the ids of pieces kept."""

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        said = json.loads(spec)
        cut = said["pre_tokenizer"] or {}
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        #: By pieces only where the library itself cuts them so.
        self.by_piece = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not said["normalizer"]
        special = [t["content"] for t in said["added_tokens"]]
        self._special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        #: Whether a token begins with a space, which in this form only the first of a piece can.
        self._spaced = np.zeros(self.library.get_vocab_size(), bool)
        self._spaced[[i for token, i in self.library.get_vocab(with_added_tokens=False).items() if token[0] == _SPACE_SYMBOL]] = True
        self._memo: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _pieces(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        """New pieces with their ids. Those led by one space are encoded many in a text: each begins where a token with a space does."""
        led = [p for p in new if p[0] == " " and len(p) > 1 and not p[1].isspace()]
        some = [p for p in new if not (p[0] == " " and len(p) > 1 and not p[1].isspace())]
        for at in range(0, len(led), JOINED * 256):
            part = led[at : at + JOINED * 256]
            joined = ["".join(part[k : k + JOINED]) for k in range(0, len(part), JOINED)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.library.encode_batch(joined, add_special_tokens=False)])
            starts = (np.flatnonzero(self._spaced[ids]) * 4).tolist()
            if len(starts) != len(part):
                some += part
                continue
            data = ids.tobytes()
            yield from ((p, data[a:b]) for p, a, b in zip(part, starts, [*starts[1:], len(data)]))
        for at in range(0, len(some), 20_000):
            yield from zip(some[at : at + 20_000], self._whole(some[at : at + 20_000]))

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        chunk: list[str] = []
        size = 0
        for text in texts:
            chunk.append(text or "")
            size += len(chunk[-1])
            if size >= CHUNK_CHARS:
                yield from self._encode(chunk)
                chunk, size = [], 0
        yield from self._encode(chunk)

    def _encode(self, chunk: list[str]) -> Iterator[bytes]:
        pieces: list[list[str] | None] = []
        for text in chunk:
            plain = self.by_piece and (text.isascii() or _PLAIN.match(text)) and not (self._special and self._special.search(text))
            pieces.append((_ASCII if text.isascii() else _LATIN).findall(text) if plain else None)
        if len(self._memo) > MEMO_PIECES:
            self._memo = {}
        self._memo.update(self._pieces(list(set().union(*(p for p in pieces if p)).difference(self._memo))))
        get = self._memo.__getitem__
        for text, cut in zip(chunk, pieces):
            yield b"".join(map(get, cut)) if cut is not None else self._whole([text])[0]


@lru_cache(1)
def encoder(spec: str) -> Encoder:
    """One vocabulary in each Python worker, which encodes in its own thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(spec)


def write_files(docs: DataFrame, folder: str, path: str, end_id: int = 0, file_ids: int = FILE_IDS, block: int = BLOCK) -> DataFrame:
    """Token files of documents (doc_id, text) in folder; the manifest: file, docs, n_tokens, start."""
    spec = docs.sparkSession.sparkContext.broadcast(spec_of(path))
    end = np.array([end_id], np.uint32)
    kinds = [("file", pa.string()), ("doc_id", pa.int64()), ("rid", pa.int64()), ("docs", pa.int64()), ("n_tokens", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, count, open_, first = encoder(spec.value), TaskContext.get().partitionId(), 0, Writer(block), None

        def flush() -> pa.RecordBatch:
            nonlocal count, open_, first
            name = f"part-{part:06d}-{count:06d}.s8b"
            put(f"{folder}/{name}", open_.data())
            row = (name, *first, len(open_.docs), open_.ids)
            count, open_, first = count + 1, Writer(block), None
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, (_, k) in zip(row, kinds)], names=[n for n, _ in kinds])

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                piece = batch.slice(at, 500)
                who, rids = piece.column("doc_id").to_pylist(), piece.column("rid").to_pylist()
                for doc, rid, ids in zip(who, rids, model.encode(piece.column("text").to_pylist())):
                    first = first or (doc, rid)
                    open_.add(doc, np.concatenate([np.frombuffer(ids, "<u4"), end]))
                    if open_.ids >= file_ids:
                        yield flush()
        if open_.docs:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("rid", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange("doc_id", "rid").sortWithinPartitions("doc_id", "rid")
    made = written(dealt.mapInArrow(run, "file string, doc_id long, rid long, docs long, n_tokens long"), "token-files")
    # One row per file: the window's single task gets no more.
    before = Window.orderBy("doc_id", "rid").rowsBetween(Window.unboundedPreceding, -1)
    return made.select("file", "docs", "n_tokens", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"))


def read_files(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """The documents of all files in folder: file, doc_id, start (in the file), n_tokens, ids_crc32 and, if asked for, ids."""
    names = ["file", "doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(file: str, held: list[tuple]) -> pa.RecordBatch:
            columns = [list(x) for x in zip(*held)]
            arrays = [pa.array([file] * len(held)), *(pa.array(c, pa.int64()) for c in columns[:4])]
            return pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, pa.list_(pa.int64())) for c in columns[4:])], names=names)

        for batch in batches:
            for file, data in zip(batch.column("path"), batch.column("content")):
                name, held, size = file.as_py().rpartition("/")[2], [], 0
                for doc, start, own in Reader(data.as_py()).documents():
                    held.append((doc, start, len(own), crc32(own.astype("<u4").tobytes()), *([own.astype(np.int64)] if ids else [])))
                    size += len(own) if ids else 1
                    if size >= 1 << 17:
                        yield rows(name, held)
                        held, size = [], 0
                if held:
                    yield rows(name, held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder)
    return files.select("path", "content").mapInArrow(run, "file string, doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if ids else ""))


def round_trip(docs: DataFrame, path: str, end_id: int = 0, file_ids: int = FILE_IDS, block: int = BLOCK) -> DataFrame:
    """Documents written as token files to the shared folder and read back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/packetloom/tokens-{uuid4().hex}"
    manifest = written(write_files(docs, folder, path, end_id, file_ids, block), "manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    starts = manifest.select("file", F.col("start").alias("before"))
    out = read_files(spark, folder, ids=False).join(starts, "file")
    return out.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
