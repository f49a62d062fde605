"""Filter interaction audit: what each filter removes in every order of the filters.

A document's failed filters are one mask. All figures of all orders follow from the number of documents
by part and mask, which are additive: they are counted once, and joined with a small fixed table that says what
each mask does at each step of each order.

One filter drops repeats of a text. A counting-Bloom prepass finds the texts that can't be repeats: every task
counts its texts' hashes in a sketch of two bit planes (seen, seen again), cut into slices of fixed
size; the partial sketches are merged slice by slice. A text with a counter that only one text has
touched is unique for certain. Only possible repeats are shuffled, as whole texts, to find the smallest
doc_id of each. The merged sketch travels to the tasks where its size, which is known before it is made, is
within ``SKETCH_BYTES``; beyond that the hashes are dealt to the slices instead. Neither way changes the result.

Texts that meet under one 64-bit hash are told apart: where a hash stands for one text among the possible
repeats, the hash names it; where it stands for several, documents are joined by the text itself.

Cases: a null or empty text has no words and fails only what no words fail; a null source is the part
'' (as is an empty one); a null doc_id has no label, comes after no other row and before none, so it never is
a repeat; rows that repeat a doc_id count each, and are no repeats of one another; a label table may repeat
a doc_id (any 1 counts) and hold nulls; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.io import sized, written

FILTERS = "ABCDE"

#: Counters of a slice of the sketch, counters for each text, hashes of each text, and the largest sketch that travels whole.
SLICE, COUNTERS, HASHES, SKETCH_BYTES = 1 << 20, 8, 3, 64 << 20

_CAPITALS = bytes(range(65, 91))
_CODE = re.compile(r"[#$%&*|]")


def failed(text: str | None) -> int:
    """The filters A to D that a text fails, as bits 0 to 3."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    few, alike = len(words) < 200, 100 * len(set(words)) < 50 * len(words)
    return few | alike << 1 | (100 * capitals > 2 * len(text)) << 2 | (_CODE.search(text) is not None) << 3


def read(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, part, h, text), nulls filled; h: a hash of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h = F.xxhash64(text) if bits == 64 else F.pmod(F.xxhash64(text), F.lit(1 << bits))
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), h.alias("h"), text.alias("text"))


def flags(rows: DataFrame) -> DataFrame:
    """(doc_id, part, h, mask): the filters that each row (doc_id, part, h, text) fails by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks: list[int] = []
            for at in range(0, batch.num_rows, 500):
                masks += map(failed, batch.column("text").slice(at, 500).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "part", "h")), pa.array(masks, pa.int32())], names=["doc_id", "part", "h", "mask"])

    return rows.mapInArrow(run, "doc_id long, part string, h long, mask int")


def places(h: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Each hash's slice, and its counters there (one row per hash)."""
    x = h.view(np.uint64)
    mixed = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    step = (mixed >> np.uint64(20)) | np.uint64(1)
    at = mixed[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]
    return ((x >> np.uint64(32)) % np.uint64(slices)).astype(np.int32), (at % np.uint64(SLICE)).astype(np.uint32)


def partial_sketches(hashes: DataFrame, slices: int, held: int = 1 << 19) -> DataFrame:
    """(slice, seen, again): the counters that a task has touched, once and more often, as 32-bit places."""

    def sketch(h: np.ndarray) -> Iterator[pa.RecordBatch]:
        which, at = places(h, slices)
        code, counts = np.unique((which.astype(np.int64)[:, None] * SLICE + at).reshape(-1), return_counts=True)
        own, first = np.unique(code // SLICE, return_index=True)
        rows = []
        for s, a, b in zip(own.tolist(), first.tolist(), [*first[1:].tolist(), len(code)]):
            place, again = (code[a:b] % SLICE).astype("<u4"), counts[a:b] > 1
            rows.append((s, place[~again].tobytes(), place[again].tobytes()))
            if len(rows) == 1000:
                yield _rows(rows)
                rows = []
        yield _rows(rows)

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.binary()))], names=["slice", "seen", "again"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, n = [], 0
        for batch in batches:
            have.append(batch.column("h").to_numpy())
            n += batch.num_rows
            if n >= held:
                yield from sketch(np.concatenate(have))
                have, n = [], 0
        if n:
            yield from sketch(np.concatenate(have))

    return hashes.mapInArrow(run, "slice int, seen binary, again binary")


class Slice:
    """Two bit planes: counters touched, and touched again."""

    def __init__(self, planes: bytes | None = None) -> None:
        both = np.frombuffer(planes, np.uint8) if planes else np.zeros(SLICE // 4, np.uint8)
        self.seen, self.again = (np.unpackbits(x) for x in np.split(both, 2))

    def merge(self, seen: bytes, again: bytes) -> None:
        once, more = np.frombuffer(seen, "<u4"), np.frombuffer(again, "<u4")
        self.again[once] |= self.seen[once]
        self.again[more] = 1
        self.seen[once] = self.seen[more] = 1

    def planes(self) -> bytes:
        return np.packbits(self.seen).tobytes() + np.packbits(self.again).tobytes()

    def possible(self, at: np.ndarray) -> np.ndarray:
        """Whether every counter of a text has been touched again."""
        return self.again[at].all(1)


def merged_sketch(partial: DataFrame) -> DataFrame:
    """(slice, planes): one row per slice. Slices are merged one after the other as their rows come, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Slice()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([held.planes()], pa.binary())], names=["slice", "planes"])

        for batch in batches:
            for s, seen, again in zip(*(batch.column(c) for c in ("slice", "seen", "again"))):
                if (s := s.as_py()) != now:
                    if now is not None:
                        yield made()
                    now, held = s, Slice()
                held.merge(seen.as_py(), again.as_py())
        if now is not None:
            yield made()

    return partial.repartition("slice").sortWithinPartitions("slice").mapInArrow(run, "slice int, planes binary")


def _with_travelling_sketch(hashes: DataFrame, sketch: DataFrame, slices: int) -> DataFrame:
    planes = hashes.sparkSession.sparkContext.broadcast({r.slice: bytes(r.planes) for r in sketch.collect()})  # SKETCH_BYTES at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, np.ndarray] = {}
        for batch in batches:
            h = np.unique(batch.column("h").to_numpy())
            which, at = places(h, slices)
            keep = np.zeros(len(h), bool)
            for s in np.unique(which).tolist():
                if s not in opened:
                    opened[s] = np.frombuffer(planes.value[s], np.uint8)[SLICE // 8 :]
                here = which == s
                keep[here] = (opened[s][at[here] >> 3] >> (7 - (at[here] & 7)).astype(np.uint8) & 1).all(1)
            yield pa.RecordBatch.from_arrays([pa.array(h[keep])], names=["h"])

    return hashes.mapInArrow(run, "h long")


def _dealt_to_slices(hashes: DataFrame, sketch: DataFrame, slices: int) -> DataFrame:
    """Each task's distinct hashes come to their slice, behind its planes."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.unique(batch.column("h").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(places(h, slices)[0]), pa.array(h)], names=["slice", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, Slice()
        for batch in batches:
            which, h, planes = batch.column("slice").to_numpy(), batch.column("h"), batch.column("planes")
            cuts = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if which[a] != now:
                    now, held, a = int(which[a]), Slice(planes[a].as_py()), a + 1
                own = h.slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own[held.possible(places(own, slices)[1])])], names=["h"])

    asked = hashes.mapInArrow(keyed, "slice int, h long").select("slice", F.lit(1).alias("kind"), "h", F.lit(None).cast("binary").alias("planes"))
    lead = sketch.select("slice", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("h"), "planes")
    dealt = lead.union(asked).repartition("slice").sortWithinPartitions("slice", "kind")
    return dealt.select("slice", "h", "planes").mapInArrow(run, "h long")


def possible_repeats(hashes: DataFrame, sketch_bytes: int = SKETCH_BYTES) -> DataFrame:
    """The hashes (h) that may stand for more than one row; all that do, and a few that don't."""
    slices = max(1, -(-hashes.count() * COUNTERS // SLICE))
    sketch = written(merged_sketch(partial_sketches(hashes, slices)), "sketch")
    probe = _with_travelling_sketch if slices * (SLICE // 4) <= sketch_bytes else _dealt_to_slices
    return written(probe(hashes, sketch, slices).distinct(), "possible")


def repeats(docs: DataFrame, bits: int = 64, sketch_bytes: int = SKETCH_BYTES) -> DataFrame:
    """(doc_id, part, mask): every document with all filters it fails, repeats of a smaller doc_id's text included."""
    rows = read(docs, bits)
    checked = written(flags(rows), "flags")
    possible = possible_repeats(checked.select("h"), sketch_bytes)
    texts = rows.join(sized(possible), "h", "left_semi")
    # Equal texts of a task are one row before they are shuffled.
    least = written(texts.groupBy("h", "text").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).drop("text"), "least")
    named = least.groupBy("h").agg(F.count("*").alias("texts"), F.min("least").alias("least"), F.sum("n").alias("n"))
    clear = written(named.filter("texts = 1 AND n > 1 AND least IS NOT NULL").select("h", "least"), "clear")
    unclear = written(named.filter("texts > 1").select("h"), "unclear")
    repeat = F.when(F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)), 1 << 4).otherwise(0)
    several = not unclear.isEmpty()
    own = checked.join(sized(unclear), "h", "left_anti") if several else checked
    out = own.join(sized(clear), "h", "left").select("doc_id", "part", (F.col("mask") + repeat).alias("mask"))
    if several:  # a hash of different texts doesn't name one: their rows are joined by the text
        again = rows.join(sized(unclear), "h", "left_semi")
        first = again.groupBy("text").agg(F.min("doc_id").alias("least"))
        told = again.join(first, "text").select("doc_id", "part", F.col("h"), "text", "least")
        # Flags are taken from the text again; what the join found travels in the place of the hash.
        told = flags(told.select("doc_id", "part", F.coalesce((F.col("doc_id") > F.col("least")).cast("long"), F.lit(0)).alias("h"), "text"))
        out = out.union(told.select("doc_id", "part", (F.col("mask") + F.col("h").cast("int") * (1 << 4)).alias("mask")))
    return out


def mask_counts(failing: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask, and how many of them have either label."""
    one = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    said = labels.filter("(quality = 1 OR toxic = 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = written(said.agg(one("quality"), one("toxic")), "labels")
    rows = failing.join(sized(said), "doc_id", "left")
    total = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long"))
    return rows.groupBy("part", "mask").agg(F.count("*").alias("n"), total("quality").alias("good"), total("toxic").alias("toxic"))


def _steps(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Fixed tables: what a mask does at a filter behind a set of filters (2560 rows), and the steps of all orders (600 rows)."""
    sets = []
    for f in range(5):
        for before in range(32):
            if not before >> f & 1:
                for mask in range(32):
                    fails, gone = mask >> f & 1, mask & before != 0
                    share = fails * 120 // max(1, mask.bit_count())
                    sets.append((before, f, mask, int(not gone and not fails), int(fails and not gone), int(fails and gone), int(mask == 1 << f), share))
    orders = []
    for order in permutations(range(5)):
        for step, f in enumerate(order):
            orders.append(("".join(FILTERS[x] for x in order), step + 1, sum(1 << x for x in order[:step]), f))
    done = "before int, f int, mask int, keeps int, removes int, repeats int, alone int, share int"
    return spark.createDataFrame(sets, done), spark.createDataFrame(orders, "filter_order string, step int, before int, f int")


def audit(docs: DataFrame, labels: DataFrame, bits: int = 64, sketch_bytes: int = SKETCH_BYTES) -> DataFrame:
    """One row per part, order of the filters and step, with the counts of documents."""
    counts = written(mask_counts(repeats(docs, bits, sketch_bytes), labels), "masks")
    sets, orders = _steps(docs.sparkSession)
    add = lambda how, what, name: F.sum(F.col(how).cast("long") * F.col(what)).alias(name)
    by_set = counts.join(F.broadcast(sets), "mask").groupBy("part", "before", "f").agg(
        add("keeps", "n", "kept"), add("removes", "n", "removed"), add("repeats", "n", "redundant"), add("alone", "n", "unique_fails"),
        add("removes", "good", "good_lost"), add("removes", "toxic", "toxic_lost"), add("share", "n", "shapley"),
    )
    return by_set.join(F.broadcast(orders), ["before", "f"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
