"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document is its ids and an end id. Whole windows of it stand alone; its rest goes to the block of
rests that its task is filling. A block is partitioned by differencing: each partial partition holds
one load per window, and the two with the largest spread are merged, the heaviest loads of one onto
the lightest of the other, until one partition of near-equal windows is left.

The window count starts at the least that can hold the block's tokens and rises whenever differencing
leaves a window above capacity, by the windows that what is over would fill, until every window fits.
Where cuts are allowed, the lightest windows are then cut up to fill the others, and what is left over goes
on to the next block; at the end of the partition it makes windows whose sizes are powers of two (which need
no padding), so no window is padded and a task leaves eleven at most that aren't full.

A task packs its own partition, block by block, in bounded memory: nothing is shuffled and no
window depends on another task. A task that runs again gives the same rows.

Cases: a null or empty text is the end id alone; a document longer than a window is cut into whole
windows and a rest; repeated rows are packed like others (each id of each row once); an empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm import bpe

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

#: Rests that are partitioned together.
BLOCK = 1024


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """The items of each window, by multiway differencing.

    A partial partition is kept as its loaded windows only, lightest first; windows without a load
    are implied, so the first merges are cheap. Nearly all merges have a single item on one side: it is put in
    its place, and only partitions of several windows on both sides are sorted. What a window holds is kept as
    a tree, so no list of items is copied on the way.
    """
    if windows == 1:
        return [list(range(len(sizes)))]
    heap: list[tuple[int, int, list[int], list]] = [(-s, i, [s], [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    fresh = len(heap)
    while len(heap) > 1:
        _, _, a, held = heapq.heappop(heap)
        _, _, b, more = heap[0]
        over = len(a) + len(b) - windows  # so many windows of both get a load from each
        if len(a) == 1 or len(b) == 1:
            lone = len(b) == 1
            load, node = (b[0], more[0]) if lone else (a[0], held[0])
            loads, nodes = (a, held) if lone else (b, more)
            if over > 0:
                load, below = load + loads.pop(0), nodes.pop(0)
                node = (below, node) if lone else (node, below)
            at = bisect_right(loads, load) if lone and over <= 0 else bisect_left(loads, load)
            loads.insert(at, load)
            nodes.insert(at, node)
        else:
            over = max(0, over)
            loads = [a[i] + b[over - 1 - i] for i in range(over)] + a[over:] + b[over:]
            nodes = [(held[i], more[over - 1 - i]) for i in range(over)] + held[over:] + more[over:]
            order = sorted(range(len(loads)), key=loads.__getitem__)
            loads, nodes = [loads[i] for i in order], [nodes[i] for i in order]
        low = loads[0] if len(loads) == windows else 0
        heapq.heapreplace(heap, (low - loads[-1], fresh, loads, nodes))
        fresh += 1
    nodes = heap[0][3] if heap else []
    return [_items(node) for node in nodes] + [[] for _ in range(windows - len(nodes))]


def _items(tree: int | tuple) -> list[int]:
    """The leaves of a tree of pairs from left to right, however deep it is."""
    out, ahead = [], [tree]
    while ahead:
        if isinstance(x := ahead.pop(), tuple):
            ahead += (x[1], x[0])
        else:
            out.append(x)
    return out


def powers(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def fitting(sizes: list[int], capacity: int) -> list[list[int]]:
    """The items of near-equal windows; the window count rises while differencing leaves one above capacity."""
    windows = -(-sum(sizes) // capacity)
    while windows:
        packed = difference(sizes, windows)
        over = sum(max(0, sum(sizes[i] for i in w) - capacity) for w in packed)
        if not over:
            return packed
        windows += -(-over // capacity)
    return []


def pack_block(sizes: list[int], capacity: int, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Windows of (item, start in the item, length). With cuts every window is full or a power of two."""
    packed = sorted(fitting(sizes, capacity), key=lambda w: -sum(sizes[i] for i in w))
    windows = [[(i, 0, sizes[i]) for i in w if sizes[i]] for w in packed]
    if not cut:
        return [w for w in windows if w]
    full, beyond = divmod(sum(sizes), capacity)
    spare = [piece for window in windows[full:] for piece in window]  # the lightest windows fill the others
    targets = [(window, capacity) for window in windows[:full]] + [([], power) for power in powers(beyond)]
    for window, size in targets:
        room = size - sum(p[2] for p in window)
        while room:
            i, start, length = spare.pop()
            take = min(room, length)
            window.append((i, start, take))
            if length > take:
                spare.append((i, start + take, length - take))
            room -= take
    return [window for window, _ in targets]


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, block: int = BLOCK, memo_words: int = bpe.MEMO_WORDS, at_once: int = 1000) -> DataFrame:
    """One row per piece: where it lies in its document, in which sequence, and at which offset.

    A worker keeps up to twice ``memo_words`` words encoded and takes ``at_once`` texts at a time: less of either takes less
    memory and more time, with the same rows.
    """
    spec = docs.sparkSession.sparkContext.broadcast(bpe.spec_of(path))
    end = int(end_id).to_bytes(4, "little")

    def rows(pieces: list[tuple]) -> pa.RecordBatch:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        columns = zip(*pieces) if pieces else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what the worker's former tasks left
        model = bpe.load(spec.value, memo_words)
        sequence = TaskContext.get().partitionId() << 40
        rests: list[tuple[int | None, int, bytes, int]] = []  # doc_id, start, ids, tokens of the document
        out: list[tuple] = []

        def flush(last: bool) -> None:
            nonlocal sequence
            over: list[tuple[int | None, int, bytes, int]] = []
            for window in pack_block([len(r[2]) // 4 for r in rests], capacity):
                full, offset = last or sum(p[2] for p in window) == capacity, 0
                for i, start, length in window:
                    doc, base, ids, total = rests[i]
                    piece = ids[4 * start : 4 * (start + length)]
                    if full:
                        out.append((doc, base + start, length, crc32(piece), total, sequence, offset))
                        offset += length
                    else:
                        over.append((doc, base + start, piece, total))
                sequence += full
            rests[:] = over

        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part = batch.slice(at, at_once)
                for doc, ids in zip(part.column("doc_id").to_pylist(), model.encode(part.column("text").to_pylist())):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total - capacity + 1, capacity):
                        out.append((doc, start, capacity, crc32(ids[4 * start : 4 * (start + capacity)]), total, sequence, 0))
                        sequence += 1
                    if total % capacity:
                        start = total // capacity * capacity
                        rests.append((doc, start, ids[4 * start :], total))
                    if len(rests) >= block:
                        flush(False)
                yield rows(out)
                out.clear()
        flush(True)
        yield rows(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
