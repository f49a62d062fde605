"""SimHash near-dedup with candidates by the generalised pigeonhole principle.

Fingerprints that differ in at most tau of 64 bits are linked. The bits are grouped into parts,
correlated bits together, and part i gets a threshold t_i, where the sum of (t_i + 1) is tau + 1: two
fingerprints within tau of each other then differ by at most t_i bits in some part (t_i = -1: the
part is not probed). How many parts there are and how the thresholds are dealt out is chosen by
dynamic programming over the estimated rows probed and candidates verified; the estimate rests on
the bits' counts and pair counts over all distinct fingerprints.

A part with threshold t is probed by meeting half-way: its value is stored under keys with up to
t // 2 bits flipped and asked for at keys with up to (t + 1) // 2, so values within t meet. Keys are grouped by
a shuffle; a task walks over its sorted keys and links the members of each key after counting the
differing bits, in large keys keeping a spanning forest only, at most one link fewer than members. A key
with more than ``hot`` members leaves that path: its members meet at keys within tau / 2 flips of the
whole fingerprint, which are within tau of each other by construction, so no pair is formed and the
work grows in proportion to the members.

Cases: null, empty and white texts have the fingerprint 0; fewer words than a shingle make one
shingle; texts of any length are read whole; equal fingerprints are one node, so copies are never
paired; a null doc_id never names a component unless all of it are null; an empty table gives no
rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb, exp, lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from packetloom.llm.components import components
from packetloom.llm.io import freed, sized, written

BITS = 64

#: Rows of a key beyond which its members are linked without pairs.
HOT = 20_000

#: Relative cost of a probed row and of a verified candidate.
ROW_COST, PAIR_COST = 1.5, 0.02

_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The 64-bit SimHash over word shingles; lower-cases A-Z and splits at ASCII white space only."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined, n = b" ".join(found), max(1, len(found) - words + 1)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[min(words, len(found)) - 1 :].tolist())], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 255):  # a byte lane counts to 255
        block = h[at : at + 255]
        for b in range(8):
            lanes = np.add.reduce((block >> np.uint64(b)) & _LANES)
            counts[b::8] += np.frombuffer(np.uint64(lanes).tobytes(), np.uint8)
    bits = np.packbits(counts * 2 > len(h), bitorder="little")
    return int(np.frombuffer(bits.tobytes(), "<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp): fingerprints as signed longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t, words, seed) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how often each pair of bits is set together, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = _bits(batch.column("fp").to_numpy().view(np.uint64)).astype(np.float32)
            for at in range(0, len(x), 1 << 16):
                total += x[at : at + (1 << 16)].T @ x[at : at + (1 << 16)]
            n += len(x)
        i, j = np.indices((BITS, BITS))
        columns = ([-1, *i.ravel()], [-1, *j.ravel()], [n, *total.ravel().astype(np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in columns], names=["i", "j", "n"])

    out, n = np.zeros((BITS, BITS)), 0
    for r in fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if r.i < 0:
            n = r.n
        else:
            out[r.i, r.j] = r.n
    return n, out


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of nearly equal size, filled one by one with the bit most correlated with the part so far."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    related = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0)
    free, out = list(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, out))) // (parts - k)
        part = [free.pop(int(np.argmax(related[np.ix_(free, free)].sum(1))))]
        while len(part) < size:
            part.append(free.pop(int(np.argmax(related[np.ix_(free, part)].sum(1)))))
        out.append(sorted(part))
    return out


def chance_within(n: int, both: np.ndarray, part: list[int], most: int) -> list[float]:
    """The estimated chance that two fingerprints differ in at most 0, 1, ..., most bits of the part.

    The number of differing bits is taken as beta-binomial with the mean and the variance that the
    bits' pair counts imply.
    """
    p11 = both[np.ix_(part, part)] / max(n, 1)
    p = np.diag(p11)
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    p00 = 1 - p11 - p10 - p01
    joint = 2 * (p11 * p00 + p10 * p01)
    differ = 2 * p * (1 - p)
    np.fill_diagonal(joint, differ)
    s, mean = len(part), float(differ.sum())
    q = min(max(mean / s, 1e-6), 1 - 1e-6)
    variance = float((joint - np.outer(differ, differ)).sum())
    rho = min(max((variance / (s * q * (1 - q)) - 1) / max(s - 1, 1), 1e-6), 0.999)
    a, b = q * (1 / rho - 1), (1 - q) * (1 / rho - 1)
    mass = lambda k: comb(s, k) * exp(lgamma(k + a) + lgamma(s - k + b) + lgamma(a + b) - lgamma(s + a + b) - lgamma(a) - lgamma(b))
    return np.cumsum([mass(k) if k <= s else 0.0 for k in range(most + 1)]).tolist()


def allocate(n: int, both: np.ndarray, tau: int) -> tuple[list[list[int]], list[int]]:
    """The parts and their thresholds of the least estimated cost."""
    best: tuple[float, list[list[int]], list[int]] | None = None
    for m in range(1, tau + 2):
        parts = group_bits(n, both, m)
        costs = []
        for part in parts:
            chance = chance_within(n, both, part, tau)
            rows = [sum(comb(len(part), f) for f in range((t + 1) // 2 + 1)) for t in range(tau + 1)]
            costs.append([0.0] + [rows[t] * n * ROW_COST + n * n / 2 * chance[t] * PAIR_COST for t in range(tau + 1)])
        # least[u]: the best way to spend u of the tau + 1 units on the parts so far
        least: list[tuple[float, list[int]]] = [(0.0, [])] + [(float("inf"), [])] * (tau + 1)
        for cost in costs:
            least = [min((least[u - k][0] + cost[k], [*least[u - k][1], k - 1]) for k in range(u + 1)) for u in range(tau + 2)]
        if best is None or least[tau + 1][0] < best[0]:
            best = (least[tau + 1][0], parts, least[tau + 1][1])
    return best[1], best[2]


def _flips(part: list[int], radius: int) -> np.ndarray:
    """All masks of up to radius bits of the part."""
    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(part, r)], np.uint64)


def probes(fps: DataFrame, parts: list[list[int]], thresholds: list[int]) -> DataFrame:
    """(part, key, asks, fp): a row per key that a fingerprint is stored under or asked for at."""
    plan = []
    for i, (part, t) in enumerate(zip(parts, thresholds)):
        if t >= 0:
            plan.append((i, np.uint64(sum(1 << b for b in part)), _flips(part, (t + 1) // 2), len(_flips(part, t // 2))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(whole), 1000):
                fp = whole[at : at + 1000]
                for i, mask, flips, stored in plan:
                    keys = ((fp & mask)[:, None] ^ flips[None, :]).ravel()
                    asks = np.tile(np.arange(len(flips)) >= stored, len(fp))
                    columns = [np.full(len(keys), i, np.int8), keys.view(np.int64), asks, np.repeat(fp, len(flips)).view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "key", "asks", "fp"])

    return fps.select("fp").mapInArrow(run, "part byte, key long, asks boolean, fp long")


def forest(fp: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of links that join the fingerprints as all links would; fewer than rows."""
    left = np.arange(1, len(fp))
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []
    queue = [0]
    while len(left):
        if queue:
            at = queue.pop()
        else:
            at, left = int(left[0]), left[1:]
        near = np.bitwise_count(fp[left] ^ fp[at]) <= tau
        if near.any():
            new = left[near]
            us.append(new)
            vs.append(np.full(len(new), at))
            queue += new.tolist()
            left = left[~near]
    empty = np.zeros(0, np.int64)
    return (np.concatenate(us), np.concatenate(vs)) if us else (empty, empty)


def links(run: np.ndarray, fp: np.ndarray, asks: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of links among the members of each key, or of a forest; a key's rows follow one another."""
    new = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    size = np.diff(np.concatenate([new, [len(run)]]))
    small = np.repeat(size <= 12, size)
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, 12):  # short runs, all at once: members d places apart
        i = np.flatnonzero((run[d:] == run[:-d]) & small[d:])
        if not len(i):
            break
        i = i[~(asks[i] & asks[i + d])]  # one of a pair is stored under the key
        ok = (np.bitwise_count(fp[i] ^ fp[i + d]) <= tau) & (fp[i] != fp[i + d])
        us.append(i[ok])
        vs.append(i[ok] + d)
    for at, n in zip(new[size > 12].tolist(), size[size > 12].tolist()):
        own = at + np.unique(fp[at : at + n], return_index=True)[1]
        u, v = forest(fp[own], tau)
        us.append(own[u])
        vs.append(own[v])
    return np.concatenate(us), np.concatenate(vs)


def link(fps: DataFrame, tau: int = 4, hot: int = HOT) -> DataFrame:
    """(u, v) links between distinct fingerprints ``fp`` that connect what all links within tau bits connect."""
    n, both = bit_statistics(fps)
    parts, thresholds = allocate(n, both, tau)
    probed = written(probes(fps, parts, thresholds), "probes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            last = np.all([x == x[-1:] for x in now[:2]], 0)
            held = [x[last] for x in now]  # its key may go on in the next batch
            yield made([x[~last] for x in now])
        if held is not None:
            yield made(held)

    def made(rows: list[np.ndarray]) -> pa.RecordBatch:
        part, key, asks, fp = rows
        u = v = np.zeros(0, np.int64)
        if len(key):
            changed = np.concatenate([[False], (part[1:] != part[:-1]) | (key[1:] != key[:-1])])
            i, j = links(np.cumsum(changed), fp.view(np.uint64), asks, tau)
            u, v = fp[i], fp[j]
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    crowded = written(probed.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("part", "key"), "crowded")
    if crowded.isEmpty():
        rest, dense = probed, None
    else:
        rest = probed.join(crowded, ["part", "key"], "left_anti")
        dense = _by_midpoints(probed.join(crowded, ["part", "key"], "left_semi").select("fp").distinct(), tau)
    dealt = rest.select("part", "key", "asks", "fp").repartition("part", "key").sortWithinPartitions("part", "key", "fp")
    out = dealt.mapInArrow(run, "u long, v long")
    return out.union(dense) if dense is not None else out


def _by_midpoints(fps: DataFrame, tau: int) -> DataFrame:
    """Links of crowded fingerprints: each to the least one that is stored under a key it asks for.

    Fingerprints are stored under all keys within tau // 2 flips and ask at those within (tau + 1) // 2, so
    whatever meets there is within tau by construction.
    """
    stored, flips = len(_flips(list(range(BITS)), tau // 2)), _flips(list(range(BITS)), (tau + 1) // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(whole), 64):
                fp = whole[at : at + 64]
                asks = np.tile(np.arange(len(flips)) >= stored, len(fp))
                columns = [(fp[:, None] ^ flips[None, :]).ravel().view(np.int64), np.repeat(fp, len(flips)).view(np.int64), asks]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "fp", "asks"])

    keys = fps.mapInArrow(run, "key long, fp long, asks boolean")
    least = keys.groupBy("key").agg(F.min(F.when(~F.col("asks"), F.col("fp"))).alias("least"), F.count("*").alias("n")).filter("n > 1 AND least IS NOT NULL")
    return keys.join(least, "key").filter("fp != least").select(F.col("fp").alias("u"), F.col("least").alias("v")).distinct()


def _in_blocks(members: DataFrame, hot: int) -> DataFrame:
    """The members (with their key's count n) of crowded keys, dealt out so that each two of a key meet in some block.

    Nodes fall into enough slots for half of ``hot`` rows each; a block is a pair of slots, and a row goes to
    the blocks of its slot with every slot.
    """
    slots = F.ceil(F.col("n") * 2 / hot)
    slot = F.pmod(F.xxhash64("node"), slots)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), slots - 1), lambda x: F.least(slot, x) * slots + F.greatest(slot, x))
    return members.withColumn("block", F.explode(pairs)).drop("n")


def group(fps: DataFrame, tau: int = 4, hot: int = HOT) -> DataFrame:
    """(fp, component_id) for rows (doc_id, fp): the least doc_id reachable over links within tau."""
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")).withColumn("node", F.col("fp")), "fingerprints")
    return _named(nodes, link(nodes, tau, hot)).select("fp", "component_id")


def _named(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes with their component's label and its least ``first``."""
    placed = written(nodes.join(components(found), "node", "left").withColumn("label", F.coalesce("label", "node")), "labels")
    named = written(placed.groupBy("label").agg(F.min("first").alias("component_id")), "named")
    return placed.join(named, "label")


def near_dedup(docs: DataFrame, tau: int = 4, words: int = 4, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    fps = written(fingerprints(docs, words), "simhash")
    out = fps.join(group(fps, tau, hot), "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingles(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of the text's word shingles, ascending."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(found), max(1, len(found) - words + 1)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[min(words, len(found)) - 1 :].tolist())], np.uint64))


def set_name(grams: np.ndarray) -> tuple[int, int]:
    """The 128-bit name of a set of shingles, as a node of 63 bits and a check of 64: equal sets have equal names."""
    whole = xxhash.xxh3_128_intdigest(grams.tobytes())
    check = whole & ((1 << 64) - 1)
    return whole >> 65, check - (1 << 64) if check >> 63 else check


def told_apart(rows: DataFrame) -> DataFrame:
    """Rows (node, check, ...) in which no two names share a node: of those that do, all but the least check get another one."""
    doubled = rows.groupBy("node").agg(F.min("check").alias("least"), F.max("check").alias("most")).filter("least < most").select("node", "least")
    doubled = written(doubled, "doubled")
    if not doubled.isEmpty():
        other = F.xxhash64("node", "check").bitwiseAND(F.lit((1 << 63) - 1))
        rows = rows.join(sized(doubled), "node", "left").withColumn("node", F.when(F.col("check") != F.col("least"), other).otherwise(F.col("node"))).drop("least")
        rows = written(rows, "numbered")
    freed(doubled)
    return rows


def set_keys(grams: np.ndarray, similarity: float) -> list[tuple[bool, np.ndarray]]:
    """(own class, keys): two sets with at least this Jaccard similarity share a key that one of them has in its own class.

    Sizes fall into classes such that similar sets lie in one class or in neighbouring ones; a set also
    visits the next larger class where one there can be similar to it. Similar sets differ in at most
    ``apart`` shingles in a class. A class deals shingles into more parts than that by their hashes, so a set
    that fills more than ``apart`` parts has a part in full common with each similar one. A set that
    fills fewer has, beside its parts, its least shingles for keys: of similar sets, these overlap.
    """
    out: list[tuple[bool, np.ndarray]] = []
    n, low, level = len(grams), 1, 0
    if not n:
        return out
    while (high := int(low / similarity + 1e-9) + 1) <= n:
        low, level = high, level + 1
    for own in (True, False):
        if not own:
            low, high, level = high, int(high / similarity + 1e-9) + 1, level + 1
            if int(n / similarity + 1e-9) < low:
                break
        apart = int(2 * (high - 1) * (1 - similarity) / (1 + similarity) + 1e-9)
        part = grams % np.uint64(apart + apart // 5 + 1)
        order = np.argsort(part, kind="stable")
        part = part[order]
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        keys = _mixed(np.add.reduceat(grams[order], starts), part[starts], 2 * level)
        if len(starts) <= apart:
            least = grams[: n - ceil(similarity * n - 1e-9) + 1]
            keys = np.concatenate([keys, _mixed(least, np.zeros(len(least), np.uint64), 2 * level + 1)])
        out.append((own, keys))
    return out


#: Words of a set's parity sketch, the least of a wide one.
SKETCH = 16


def parities(grams: np.ndarray, words: int = SKETCH) -> np.ndarray:
    """How many shingles fall to each bit, odd or even: two sets differ in at least as many shingles as sketches in bits."""
    odd = np.bincount((grams >> np.uint64(38)).astype(np.int64) % (64 * words), minlength=64 * words) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def wide_parities(grams: np.ndarray) -> np.ndarray:
    """A sketch with twice as many bits as shingles at least, so that it doesn't fill up: a power of two words, which fold onto fewer."""
    return parities(grams, max(SKETCH, 1 << max(0, (len(grams) - 1) // 32).bit_length()))


def folded(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sketches of one key as rows of the least width among them; bit i of a wide one falls to bit i modulo the width."""
    width = int(sizes.min())
    if int(sizes.max()) == width:
        return flat[starts[0] : starts[0] + width * len(sizes)].reshape(-1, width)
    return np.stack([np.bitwise_xor.reduce(flat[a : a + n].reshape(-1, width)) for a, n in zip(starts.tolist(), sizes.tolist())])


def _mixed(x: np.ndarray, part: np.ndarray, level: int) -> np.ndarray:
    x = (x ^ ((part + np.uint64(level << 40)) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


_OWN = np.int64(-1 << 63)


def sharing(rows: DataFrame, similarity: float, words: int) -> DataFrame:
    """(key, node, own, head): the sets under a key but its head, the first that has the key in its own class."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            keys, who = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for node, text in zip(batch.column("node").to_pylist(), batch.column("text")):
                if node in seen:
                    continue
                seen.add(node)
                grams = shingles(text.as_py(), words)
                for own, made in set_keys(grams, similarity):
                    keys.append(made)
                    who.append(np.full(len(made), np.int64(node) | (_OWN if own else np.int64(0))))
                if sum(map(len, keys)) > 1 << 18:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, who)], names=["key", "who"])
                    keys, who = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, who)], names=["key", "who"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple[np.ndarray, ...] | None = None  # the last row's key, set and head
        for batch in batches:
            key, who = (batch.column(c).to_numpy() for c in ("key", "who"))
            if not len(key):
                continue
            if before is not None:
                key, who = np.concatenate([before[0], key]), np.concatenate([before[1], who])
            new = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            head = who[first]
            if before is not None:
                head[first == 0] = before[2][0]
            again = np.concatenate([[True], (who[1:] == who[:-1]) & ~new[1:]])
            take = (head < 0) & (head != who) & ~again
            before = (key[-1:], who[-1:], head[-1:])
            columns = [key[take], who[take] & ~_OWN, who[take] < 0, head[take] & ~_OWN]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "node", "own", "head"])

    dealt = rows.select("node", "text").mapInArrow(keyed, "key long, who long").repartition("key").sortWithinPartitions("key", "who")
    return dealt.mapInArrow(met, "key long, node long, own boolean, head long")


def unjoined(members: DataFrame, sets: DataFrame, similarity: float, hot: int = HOT) -> DataFrame:
    """(u, v) of all members (key, node, own, label) of a key that have different labels, one of them in its own class.

    Pairs whose wide sketches and sizes (in ``sets``) already show that they are not similar are left out; keys
    with the same members count once.
    """
    same = [F.bit_xor(F.xxhash64("node", "own")), F.bit_xor(F.xxhash64("own", "node", F.lit(1)))]
    mixed = members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), same[0].alias("a"), same[1].alias("b")).filter("lo < hi")
    mixed = mixed.groupBy("n", "a", "b").agg(F.min("key").alias("key"))  # keys with the same members give the same pairs
    mixed = written(members.join(mixed.select("key", "n"), "key").join(sets.select("node", "size", "wide"), "node"), "mixed")
    few = mixed.filter(F.col("n") <= hot).drop("n").withColumn("block", F.lit(0).cast("long"))
    dealt = few.unionByName(_in_blocks(mixed.filter(F.col("n") > hot), hot))

    def pairs(key: np.ndarray, block: np.ndarray, label: np.ndarray, node: np.ndarray, own: np.ndarray, size: np.ndarray, width: np.ndarray, flat: np.ndarray) -> Iterator[pa.RecordBatch]:
        run = np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
        group = run | np.concatenate([[True], label[1:] != label[:-1]])
        at_word = np.cumsum(width) - width
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        firsts = np.flatnonzero(run)
        for first, end in zip(firsts.tolist(), [*firsts[1:].tolist(), len(key)]):
            sketch = folded(flat, at_word[first:end], width[first:end])
            starts = (np.flatnonzero(group[first:end]) + first).tolist()
            for at, to in zip(starts, starts[1:]):  # the last label has none behind it
                step = max(1, (1 << 20) // (sketch.shape[1] * (end - to)))
                for low in range(at, to, step):
                    i = np.repeat(np.arange(low, min(to, low + step)), end - to)
                    j = np.tile(np.arange(to, end), min(to, low + step) - low)
                    ok = (own[i] | own[j]) & (size[i] >= similarity * size[j] - 1e-9) & (size[j] >= similarity * size[i] - 1e-9)
                    i, j = i[ok], j[ok]
                    ok = np.bitwise_count(sketch[i - first] ^ sketch[j - first]).sum(1) <= (size[i] + size[j]) * (1 - similarity) / (1 + similarity) + 1e-9
                    us.append(node[i[ok]])
                    vs.append(node[j[ok]])
                    if sum(map(len, us)) > 1 << 18:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs)], names=["u", "v"])
                        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (us, vs)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # rows of a key that may go on in the next batch
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names[:-1]]
            if not len(now[0]):
                continue
            width = np.diff(batch.column("wide").offsets.to_numpy()).astype(np.int64)
            flat = batch.column("wide").flatten().to_numpy().view(np.uint64)
            last = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            if last.all() and (not held or held[-1][0][0] == now[0][0] and held[-1][1][0] == now[1][0]):
                held.append([*now, width, flat])
                continue
            # Rows are sorted, so those of the last key stand at the end.
            cut, words = int(np.argmax(last)), int(width[~last].sum())
            yield from pairs(*(np.concatenate(x) for x in zip(*held, [*(x[:cut] for x in now), width[:cut], flat[:words]])))
            held = [[*(x[cut:] for x in now), width[cut:], flat[words:]]]
        if held:
            yield from pairs(*(np.concatenate(x) for x in zip(*held)))

    columns = ["key", "block", "label", "node", "own", "size", "wide"]
    sorted_ = dealt.select(columns).repartition("key", "block").sortWithinPartitions("key", "block", "label", "node")
    found = sorted_.mapInArrow(run, "u long, v long")
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those (u, v) whose sets (node, grams, size, sketch) have at least this Jaccard similarity."""
    ends = lambda *columns: [sets.select(F.col("node").alias(at), *(F.col(c).alias(f"{c}_{at}") for c in columns)) for at in "uv"]
    for side, at in zip(ends("size", "sketch"), "uv"):
        pairs = pairs.join(side, at)
    bits = F.aggregate(F.zip_with("sketch_u", "sketch_v", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
    small, large = F.least("size_u", "size_v"), F.greatest("size_u", "size_v")
    open_ = pairs.filter((small >= similarity * large - 1e-9) & (bits <= (small + large) * (1 - similarity) / (1 + similarity) + 1e-9))
    both = written(open_.select("u", "v"), "open")
    asked = written(both.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "asked")
    sets = sets.join(sized(asked), "node", "left_semi")
    for side, at in zip(ends("grams"), "uv"):
        both = both.join(side.withColumnRenamed(f"grams_{at}", {"u": "a", "v": "b"}[at]), at)
    common = F.size(F.array_intersect("a", "b"))
    return both.filter(common / (F.size("a") + F.size("b") - common) >= similarity).select("u", "v")


def keep_one(docs: DataFrame, similarity: float = 0.8, words: int = 5, hot: int = HOT, bits: int = 63) -> DataFrame:
    """The documents without near copies: of each group the smallest doc_id stays (nulls last), in one row.

    Two documents are linked where the sets of their word shingles have at least this Jaccard similarity;
    a group is what links connect. The generalised pigeonhole is applied to the sets themselves instead of
    to bits that are drawn from them, so all similar sets share a key (``set_keys``). First each set is
    compared with the head of its keys; then those under one key that are not joined yet are compared
    with one another. Nothing goes without a comparison of whole sets, but equal ones: sets are equal where
    their 128-bit names are.

    Cases: null, empty and white texts have the empty set and are one group, of which one row stays; fewer words
    than a shingle make one shingle; texts of any length are compared whole; of rows that repeat a doc_id the first in
    the table stays; rows with a null doc_id stay only where their group has no other; an empty table gives an
    empty table.

    Rows travel as one column and are written with their numbers first, so extra columns may have any
    names, and numbers don't depend on how ``docs`` was made.
    """

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [set_name(shingles(t.as_py(), words)) for t in batch.column("row").field(at)]
            nodes, checks = zip(*made) if made else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([n >> 63 - bits for n in nodes], pa.int64()), pa.array(checks, pa.int64())], names=["row", "node", "check"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in batch.column("text").to_pylist()]
            lists = [pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array([len(x) for x in sets], pa.int64()), pa.array([parities(x) for x in sets], pa.list_(pa.int64())), pa.array([wide_parities(x) for x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), *lists], names=["node", "grams", "size", "sketch", "wide"])

    at = docs.columns.index("text")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    schema = StructType([StructField("row", whole.schema["row"].dataType), StructField("node", LongType()), StructField("check", LongType())])
    rows = told_apart(written(whole.mapInArrow(named, schema).withColumn("rid", F.monotonically_increasing_id()), "numbered"))
    doc = F.col("row.doc_id").cast("long")
    order = F.struct(doc.isNull().alias("none"), doc.alias("doc_id"), "rid")
    nodes = written(rows.groupBy("node").agg(F.min(order).alias("first"), F.count("*").alias("copies")), "sets")
    copies = rows.select("rid", "node").join(nodes.filter("copies > 1").select("node", F.col("first.rid").alias("kept")), "node").filter("rid != kept")
    copies = written(copies.select("rid"), "copies")
    reps = rows.select("rid", "node", F.col("row.text").alias("text")).join(sized(copies), "rid", "left_anti")
    shared = written(sharing(reps, similarity, words), "shared")
    star = written(shared.select(F.greatest("node", "head").alias("u"), F.least("node", "head").alias("v")).distinct(), "stars")
    ends = written(star.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes, "node").select(F.col("first.rid").alias("rid")), "ends")
    sets = rows.select("rid", "node", F.col("row.text").alias("text")).join(sized(ends), "rid", "left_semi").select("node", "text")
    sets = written(sets.mapInArrow(gathered, "node long, grams array<long>, size long, sketch array<long>, wide array<long>"), "shingles")
    near = written(similar(star, sets, similarity), "near")
    label = written(components(near), "joined")
    members = shared.select("key", "node", "own").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rest = written(unjoined(members, sets, similarity, hot).join(star, ["u", "v"], "left_anti"), "unjoined")
    found = near.union(similar(rest, sets, similarity))
    kept = _named(nodes, found).select("node", F.col("component_id.rid").alias("kept"))
    gone = written(rows.select("rid", "node").join(kept, "node").filter("rid != kept").select("rid"), "gone")
    freed(shared, star, copies, ends, sets, near, label, rest)
    return rows.join(sized(gone), "rid", "left_anti").select("row.*")
