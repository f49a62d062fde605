"""Sharding by a k-d tree over metadata, built from distributed weighted medians.

Equal texts are one point: their bytes add up, and they share the least language and source and the
length of their text. Languages and sources count by their rank among the distinct values. A node holds the points of some shards; it is split along the dimension in
which its points spread widest, at the weighted quantile that leaves each side the bytes of its
shards, until a node is one shard (its points have the target bytes). Within equal coordinates
points are ordered by a hash, so a split can fall inside a crowded coordinate.

A quantile is found by refining a histogram: points are counted into a fixed number of buckets per
node, the bucket that holds the quantile is divided again, and so on until it holds little or one
point. The driver sees these histograms only (nodes x buckets rows, whatever the input), and all
nodes of a level are refined by the same job. Every point's node follows from the cuts so far.

Cases: a null text has no bytes and equals an empty one; null metadata come first; a point larger
than a shard's share stays whole and takes a shard of its own as far as cuts allow; ties are ordered
by hash; repeated rows get a slot each; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.io import written

#: Buckets of a node's histogram, bits of a coordinate, bits of the hash behind it.
BUCKETS, COORD_BITS, HASH_BITS = 512, 24, 38

DIMENSIONS = ("length", "source", "lang")


@dataclass
class Node:
    """A node that is to be split: ``left`` of its shards go below ``cut`` along its dimension."""

    id: int
    first: int
    shards: int
    dim: int = 0
    cut: int = 0
    left: int = 0


def documents(docs: DataFrame, overhead: int = 16) -> DataFrame:
    """What sharding needs of a document; its text doesn't travel."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("point"),
        F.char_length(text).alias("n"),
        "source",
        "lang",
    )


def points(rows: DataFrame) -> DataFrame:
    """One row per distinct text: its bytes and its coordinates as numbers."""
    grouped = rows.groupBy("point").agg(
        F.sum("size").alias("bytes"),
        F.count("*").alias("copies"),
        F.first("n").alias("n"),
        *(F.min(F.struct(F.col(c).isNotNull().alias("some"), F.col(c).alias("value"))).alias(c) for c in ("source", "lang")),
    )
    out = grouped.select("point", "bytes", "copies", F.log2(F.col("n") + 1.0).alias("length"), "source.value", F.col("lang.value").alias("lang"))
    out = written(out.withColumnRenamed("value", "source"), "texts")
    for c in ("source", "lang"):
        held = ranks(out.select(c)).withColumnRenamed("rank", f"rank_{c}")
        out = out.join(held, c, "left").withColumn(c, F.coalesce(f"rank_{c}", F.lit(-1.0))).drop(f"rank_{c}")
    return out.select("point", "bytes", "copies", "length", "source", "lang")


def ranks(values: DataFrame) -> DataFrame:
    """(value, rank) of the distinct values of a column, in their order: places within ranges of values, behind the counts of the ranges before."""
    c = values.columns[0]
    spread = values.filter(F.col(c).isNotNull()).distinct().repartitionByRange(c).withColumn("part", F.spark_partition_id())
    spread = written(spread, "values")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = spread.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(c))
    return spread.withColumn("place", place).join(offsets, "part").select(c, (F.col("offset") + F.col("place")).cast("double").alias("rank"))


def keyed(pts: DataFrame) -> DataFrame:
    """Points with one ordering key per dimension: the coordinate, scaled to the table's range, then a hash."""
    ends = pts.agg(*(f(c).alias(f"{n}_{c}") for c in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max)))).first()
    tie = F.shiftrightunsigned(F.xxhash64("point"), 64 - HASH_BITS)
    keys = []
    for c in DIMENSIONS:
        lo, hi = ends[f"lo_{c}"] or 0.0, ends[f"hi_{c}"] or 0.0
        scaled = F.floor((F.col(c) - lo) / ((hi - lo) or 1.0) * ((1 << COORD_BITS) - 1)).cast("long")
        keys.append((F.shiftleft(scaled, HASH_BITS) + tie).alias(c))
    return pts.select("point", "bytes", "copies", *keys)


def _of(values: dict[int, int]) -> Column:
    """The value of a row's node, null for nodes without one."""
    held = [values.get(i) for i in range(max(values) + 1)]
    return F.get(F.expr("array(" + ", ".join("CAST(NULL AS BIGINT)" if v is None else f"{v}L" for v in held) + ")"), F.col("node"))


def _key(dims: dict[int, int]) -> Column:
    """A row's ordering key in its node's dimension."""
    return F.get(F.array(*DIMENSIONS), _of(dims).cast("int"))


def assign(pts: DataFrame, shards: int, tolerance: float = 0.001) -> DataFrame:
    """Points with the shard they lie in; the tree grows by a level per round, written to the shared folder."""
    nodes, made = [Node(0, 0, shards)], 1
    firsts = {0: 0}
    placed = pts.withColumn("node", F.lit(0))
    while active := [x for x in nodes if x.shards > 1]:
        spans = placed.groupBy("node").agg(F.sum("bytes").alias("bytes"), *(f(c).alias(f"{n}_{c}") for c in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))))
        found = {r.node: r for r in spans.collect()}
        ranges = {}
        for x in active:
            x.left = x.shards // 2
            if r := found.get(x.id):  # without points any cut will do
                x.dim = max(range(len(DIMENSIONS)), key=lambda i: (r[f"hi_{DIMENSIONS[i]}"] >> HASH_BITS) - (r[f"lo_{DIMENSIONS[i]}"] >> HASH_BITS))
                ranges[x.id] = Range(x, r[f"lo_{DIMENSIONS[x.dim]}"], r[f"hi_{DIMENSIONS[x.dim]}"] + 1, r.bytes)
        while ranges:
            ranges = _refine(placed, ranges, tolerance)
        low, high, nodes = {}, {}, [x for x in nodes if x.shards == 1]
        for x in active:
            low[x.id], high[x.id] = made, made + 1
            nodes += [Node(made, x.first, x.left), Node(made + 1, x.first + x.left, x.shards - x.left)]
            firsts |= {n.id: n.first for n in nodes[-2:]}
            made += 2
        below = _key({x.id: x.dim for x in active}) < _of({x.id: x.cut for x in active})
        moved = F.when(below, _of(low)).otherwise(_of(high)).cast("int")
        placed = written(placed.withColumn("node", F.coalesce(moved, "node")), "level")
    return placed.withColumn("shard", _of(firsts).cast("int")).drop("node")


@dataclass
class Range:
    """The keys among which a node's cut is sought; ``below`` are the bytes before them."""

    node: Node
    lo: int
    hi: int
    total: int
    below: int = 0

    @property
    def width(self) -> int:
        return max(1, -(-(self.hi - self.lo) // BUCKETS))


def _refine(placed: DataFrame, ranges: dict[int, Range], tolerance: float) -> dict[int, Range]:
    """One histogram for all sought cuts; settles a cut or returns the narrower range."""
    rows = placed.select(
        "node",
        "bytes",
        _key({i: s.node.dim for i, s in ranges.items()}).alias("key"),
        _of({i: s.lo for i, s in ranges.items()}).alias("lo"),
        _of({i: s.hi for i, s in ranges.items()}).alias("hi"),
        _of({i: s.width for i, s in ranges.items()}).alias("width"),
    ).filter("key >= lo AND key < hi")
    held: dict[int, list[tuple[int, int]]] = {i: [] for i in ranges}
    for r in rows.groupBy("node", F.expr("(key - lo) div width").alias("bucket")).agg(F.sum("bytes").alias("bytes")).collect():
        held[r.node].append((r.bucket, r.bytes))
    left_over = {}
    for i, s in ranges.items():
        k = s.node.shards
        want, below = s.total * (k // 2) / k, s.below
        for bucket, size in sorted(held[i]):
            if below + size >= want:
                break
            below += size
        start = s.lo + bucket * s.width
        if s.width > 1 and size > tolerance * s.total / k:
            left_over[i] = Range(s.node, start, min(start + s.width, s.hi), s.total, below)
            continue
        # Before or after the bucket, and with how many shards on the left: whichever leaves the fuller side least full.
        choices = []
        for cut, left in ((start, below), (start + s.width, below + size)):
            for n in {max(1, min(k - 1, f(left / s.total * k))) for f in (math.floor, math.ceil)}:
                choices.append((max(left / n, (s.total - left) / (k - n)), cut, n))
        _, s.node.cut, s.node.left = min(choices)
    return left_over


def shard(docs: DataFrame, shards: int = 40, slot_block: int = 1024, tolerance: float = 0.001) -> DataFrame:
    """One row per document: its size, the shard it lies in, and its place there."""
    rows = written(documents(docs), "sizes")
    pts = written(keyed(points(rows)), "points")
    where = assign(pts, shards, tolerance).select("point", "shard")
    n = rows.count()
    sub = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(max(1, -(-n // (shards * slot_block))))).cast("int")
    placed = rows.select("doc_id", "size", "text_crc32", "point").join(where, "point").drop("point").withColumn("sub", sub)
    placed = written(placed, "placed")
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "sub").agg(F.count("*").alias("n"))
    offsets = offsets.select("shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("row", F.row_number().over(within))
        .join(offsets, ["shard", "sub"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("row") - 1 + F.col("offset")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
