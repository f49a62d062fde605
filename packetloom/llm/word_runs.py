"""Periodic runs of words, by grammar compression.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4 q) words that no
neighbouring word extends. Each document is compressed by Re-Pair: the most frequent pair of neighbouring
symbols becomes a nonterminal until no pair occurs twice; what is left is halved again and again, so the
document has one derivation tree. Every run lies in the node whose boundary it crosses and whose words hold
it whole. The runs across a nonterminal's boundary are computed once (both parts of the boundary's words are
held against what follows or precedes at each distance, by prefix hashes, and every hit is then compared
word by word), translated to all positions where the nonterminal is derived, and intervals of one
period that overlap by a period or more are merged.

A run holds each of its pairs of words three times at least. So a boundary whose pair occurs less often in
the document lies in no run: the words are cut there before they are compressed, and only stretches of at
least six words take part. That loses no run.

A document is one row in one task; only its own words are held. Nothing is shuffled.

Cases: null, empty and white texts have no words and no run; texts of any length are read whole; repeated
rows get equal rows; ties for the longest run go to the smallest start, then period; an empty table gives
no rows. Extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has at least so many words, and so many periods.
LEAST, TIMES = 6, 4
#: Words that are looked through together.
CHUNK_WORDS = 1 << 18

_BASE = 0x9E3779B97F4A7C15


def words_of(text: str | None) -> list[bytes]:
    """Maximal pieces without ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def repeated_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic tail in one document of ten, as its id's checksum says; a null id leaves them alone."""
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def stretches(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the stretches whose pairs of words all occur three times, in documents that end at ``ends``.

    Ids of different documents differ.
    """
    if len(ids) < LEAST:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, which, counts = np.unique((ids[:-1] << 32) | ids[1:], return_inverse=True, return_counts=True)
    live = counts[which] >= TIMES - 1
    live[ends[(ends > 0) & (ends < len(ids))] - 1] = False  # pairs across two documents
    edge = np.diff(np.concatenate([[0], live.astype(np.int8), [0]]))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = last - first + 1 >= LEAST
    return first[long], (last - first + 1)[long]


class Grammar:
    """Re-Pair over some stretches of a document: rules and the symbols that are left, by the place of their first word."""

    def __init__(self, ids: list[int], parts: list[tuple[int, int]]) -> None:
        #: Of nonterminal k: left and right symbol (k < 0: nonterminal ~k), a place where it occurs, and words of its left part and in all.
        self.rules: list[tuple[int, int, int, int, int]] = []
        places = [p for at, n in parts for p in range(at, at + n)]
        self._sym = {p: ids[p] for p in places}
        self._after = {p: p + 1 for at, n in parts for p in range(at, at + n - 1)}
        self._before = {q: p for p, q in self._after.items()}
        index: dict[tuple[int, int], list[int]] = {}
        for p, q in self._after.items():
            index.setdefault((ids[p], ids[q]), []).append(p)
        heap = [(-len(at), pair) for pair, at in index.items() if len(at) > 1]
        heapq.heapify(heap)
        while heap:
            count, pair = heapq.heappop(heap)
            here = self._current(pair, index.pop(pair, []))
            if len(here) < 2:
                continue
            if heap and -heap[0][0] > len(here):  # others are more frequent by now
                index[pair] = here
                heapq.heappush(heap, (-len(here), pair))
                continue
            for made, at in self._replace(pair, here).items():
                index[made] = at + index.get(made, [])
                if len(index[made]) > 1:
                    heapq.heappush(heap, (-len(index[made]), made))
        #: Per stretch: places of the symbols left, and the end.
        self.tops: list[list[int]] = []
        for at, n in parts:
            top, p = [], at
            while p is not None:
                top.append(p)
                p = self._after.get(p)
            self.tops.append([*top, at + n])

    def symbol(self, place: int) -> int:
        return self._sym[place]

    def length(self, symbol: int) -> int:
        return self.rules[~symbol][4] if symbol < 0 else 1

    def _current(self, pair: tuple[int, int], places: list[int]) -> list[int]:
        """Those places where the pair still stands, without overlaps, from left to right."""
        (a, b), out, free = pair, [], -1
        for p in sorted(set(places)):
            if p >= free and self._sym.get(p) == a and (q := self._after.get(p)) is not None and self._sym[q] == b:
                out.append(p)
                free = q + 1 if a == b else q
        return out

    def _replace(self, pair: tuple[int, int], places: list[int]) -> dict[tuple[int, int], list[int]]:
        """The pair's places become a new nonterminal; the pairs around it, with their places."""
        sym, after, before = self._sym, self._after, self._before
        name, left = ~len(self.rules), self.length(pair[0])
        self.rules.append((*pair, places[0], left, left + self.length(pair[1])))
        for p in places:
            q = after[p]
            sym[p] = name
            del sym[q], before[q]
            if (r := after.pop(q, None)) is None:
                del after[p]
            else:
                after[p], before[r] = r, p
        made: dict[tuple[int, int], list[int]] = {}
        for p in places:
            if (r := after.get(p)) is not None:
                made.setdefault((name, sym[r]), []).append(p)
            if (o := before.get(p)) is not None and sym[o] != name:
                made.setdefault((sym[o], name), []).append(o)
        return made


def _spread(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) + np.uint64(_BASE)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Hashed:
    """Words with the hashes of all their prefixes."""

    def __init__(self, ids: np.ndarray) -> None:
        self.ids = ids
        self.power = np.full(len(ids) + 1, _BASE, np.uint64)
        self.power[0] = 1
        self.power = np.multiply.accumulate(self.power)
        self.upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_spread(ids) * self.power[:-1], dtype=np.uint64)])

    def crossing(self, low: int, mid: int, high: int) -> list[tuple[int, int, int]]:
        """The runs (start, end, period) of the words in [low, high) that have words on both sides of mid.

        A run has two periods on one side of mid at least. There the first or last of them is held
        against its neighbour; a period that a smaller one's run already explains is none of its own.
        """
        ids, upto, out = self.ids, self.upto, []
        for forward in (True, False):
            most = min((high - low) // TIMES, (high - mid if forward else mid - low) // 2)
            if most < 1:
                continue
            same = ids[mid + 1 : mid + most + 1] == ids[mid] if forward else ids[mid - most - 1 : mid - 1][::-1] == ids[mid - 1]
            q = np.flatnonzero(same) + 1
            if not len(q):
                continue
            a, b, c = (mid, mid + q, mid + 2 * q) if forward else (mid - 2 * q, mid - q, mid)
            q = q[(upto[b] - upto[a]) * self.power[q] == upto[c] - upto[b]]
            while len(q):
                p = int(q[0])
                differs = np.flatnonzero(ids[mid + p : high] != ids[mid : high - p])
                right = int(differs[0]) if len(differs) else high - mid - p
                differs = np.flatnonzero(ids[low : mid - p] != ids[low + p : mid]) if not forward else np.flatnonzero(ids[low:mid] != ids[low + p : mid + p])
                if forward:
                    start, end = (low + int(differs[-1]) + 1 if len(differs) else low), mid + p + right
                else:
                    start = low + int(differs[-1]) + 1 if len(differs) else low
                    differs = np.flatnonzero(ids[mid:high] != ids[mid - p : high - p])
                    end = mid + int(differs[0]) if len(differs) else high
                if end - start >= max(LEAST, TIMES * p) and start < mid < end:
                    out.append((start, end, p))
                # With the square inside a smaller period's stretch, the longer period is a multiple of it.
                reach = (end - mid) // 2 if forward else (mid - start) // 2
                q = q[q > max(p, reach)]
        return out


def merged(found: np.ndarray) -> np.ndarray:
    """Maximal intervals of rows (start, end, period): those of one period that overlap by it or more are one."""
    if not len(found):
        return found
    found = found[np.lexsort((found[:, 0], found[:, 2]))]
    start, end, period = found.T
    step = int(end.max()) + 1
    band = (np.cumsum(np.concatenate([[0], period[1:] != period[:-1]])) * 2) * step
    reach = np.maximum.accumulate(end + band)
    first = np.flatnonzero(np.concatenate([[True], (start + period + band)[1:] > reach[:-1]]))
    out = np.stack([start[first], np.maximum.reduceat(end, first), period[first]], 1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs(ids: np.ndarray, parts: list[tuple[int, int]]) -> np.ndarray:
    """The runs (start, end, period) of a document by start, then period; parts: its stretches (first place, words)."""
    if not parts:
        return np.zeros((0, 3), np.int64)
    grammar, text = Grammar(ids.tolist(), parts), Hashed(ids)
    found: list[np.ndarray] = []
    occurs: dict[int, list[np.ndarray]] = {}
    for top in grammar.tops:  # nodes above the symbols that are left: each is derived once
        nodes = [(0, len(top) - 1)]
        while nodes:
            i, k = nodes.pop()
            if k - i < 2 or top[k] - top[i] < LEAST:
                continue
            j = (i + k) // 2
            if own := text.crossing(top[i], top[j], top[k]):
                found.append(np.array(own, np.int64))
            nodes += [(i, j), (j, k)]
        for p in top[:-1]:
            if (s := grammar.symbol(p)) < 0:
                occurs.setdefault(s, []).append(np.array([p], np.int64))
    for k in range(len(grammar.rules) - 1, -1, -1):
        left, right, place, mid, n = grammar.rules[k]
        if n < LEAST or ~k not in occurs:
            continue  # its parts are shorter still
        at = np.concatenate(occurs.pop(~k))
        if own := text.crossing(place, place + mid, place + n):
            for start, end, period in own:
                found.append(np.stack([at + (start - place), at + (end - place), np.full(len(at), period, np.int64)], 1))
        for s, shift in ((left, 0), (right, mid)):
            if s < 0:
                occurs.setdefault(s, []).append(at + shift)
    return merged(np.concatenate(found)) if found else np.zeros((0, 3), np.int64)


def detect(documents: list[list[bytes]]) -> Iterator[np.ndarray]:
    """The runs (start, end, period) of each document's words."""
    flat, ends, known = [], [], 0
    for words in documents:
        names: dict[bytes, int] = {}
        flat.append(np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words)) + known)
        known += len(names)
        ends.append(len(words))
    ids, ends = np.concatenate(flat) if flat else np.zeros(0, np.int64), np.cumsum(ends, dtype=np.int64)
    first, size = stretches(ids, ends)
    cut = np.searchsorted(first, ends)
    at = k = 0
    for own, end, upto in zip(flat, ends.tolist(), cut.tolist()):
        yield runs(own, [(int(f) - at, int(n)) for f, n in zip(first[k:upto], size[k:upto])])
        at, k = end, upto


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words that no run repeats after its first period, with spaces between."""
    if not len(found):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def report(docs: DataFrame, tails: bool = False) -> DataFrame:
    """One row per document: its runs' number and digest, the longest, and the digest of the collapsed text.

    With ``tails``, one document of ten gets a periodic tail first (``repeated_tail``).
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def rows(ids: list[int | None], documents: list[list[bytes]]) -> pa.RecordBatch:
        out: list[tuple] = []
        for doc, words, found in zip(ids, documents, detect(documents)):
            best: tuple = (None,) * 4
            if len(found):
                start, end, period = found[np.lexsort((found[:, 2], found[:, 0], found[:, 0] - found[:, 1]))[0]].tolist()
                best = (start, end - start, period, 1000 * (end - start) // period)
            lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found.tolist())
            out.append((doc, len(found), *best, sha256(lines.encode()).hexdigest(), sha256(collapsed(words, found)).hexdigest()))
        columns = zip(*out) if out else [[] for _ in names]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("sha256") else pa.int64()) for n, c in zip(names, columns)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, documents, size = [], [], 0
            for doc, text in zip(batch.column("doc_id"), batch.column("text")):
                words = words_of(text.as_py())
                ids.append(doc.as_py())
                documents.append(repeated_tail(words, ids[-1]) if tails else words)
                size += len(words)
                if size >= CHUNK_WORDS:
                    yield rows(ids, documents)
                    ids, documents, size = [], [], 0
            yield rows(ids, documents)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def collapse(docs: DataFrame) -> DataFrame:
    """docs with the collapsed text in place of each text that has runs; others stay as they are."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            out: list[str | None] = []
            for k in range(0, batch.num_rows, 200):
                texts = column.slice(k, 200).to_pylist()
                documents = [words_of(t) for t in texts]
                out += [collapsed(w, f).decode("utf-8", "surrogatepass") if len(f) else t for t, w, f in zip(texts, documents, detect(documents))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.string()), *batch.columns[at + 1 :]], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
