"""BPE encoding and decoding by a pair occurrence index.

Every task works on chunks of its partition. The distinct words of a chunk are laid out in one flat
array of symbols; an index maps each adjacent pair that has a merge to all its positions. Active
ranks are taken in ascending order from a heap; applying a rank visits the listed positions once,
and only the lists of the pairs that appear around a merge are updated. Repeated words are encoded
once per chunk and kept in a bounded memo, so the work follows the distinct words.

Applying ranks in ascending order over all words at once gives the result of word-by-word BPE if a
merged token never takes part in a merge of a lower rank. ``Bpe`` verifies that of its vocabulary.

Cases: a null or empty text has no ids and decodes to the empty string; texts of any length are
encoded whole; repeated rows and ties get equal rows; an empty table gives an empty table. Extra
columns are carried through by ``encode`` and ``decode`` unless they clash with the output column,
which is then replaced.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters for which Python's lower-casing and the classes below are the tokenizer's own; other texts
#: take the tokenizer's normaliser and pre-tokeniser.
_PLAIN = re.compile(r"[\x00-įı-ž]*\Z")
_LETTER, _NUMBER, _SPACE = "a-zA-ZªµºÀ-ÖØ-öø-ž", "0-9²³¹¼-¾", "\\x09-\\x0d\\x20\u0085 "
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")

#: Characters of text that are split into words at once, and words kept encoded between chunks.
CHUNK_CHARS, MEMO_WORDS = 1 << 22, 400_000
#: Words that are merged in one array, so that what a chunk needs beside the memo has a bound of its own.
AT_ONCE = 1 << 15
#: Ranks below this are applied to their lists as arrays.
LONG_LISTS = 2500


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies (a fixed public table, built by its rule)."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in printable:
            out[b] = chr(b)
        else:
            out[b], spare = chr(spare), spare + 1
    return out


class Bpe:
    """A vocabulary of the tokenizers library's JSON form: byte-level symbols, BPE with a word-end suffix."""

    def __init__(self, spec: str, memo_words: int = MEMO_WORDS) -> None:
        from tokenizers import Tokenizer

        said = json.loads(spec)
        model, vocab = said["model"], said["model"]["vocab"]
        self._library = Tokenizer.from_str(spec)
        end, symbols = model.get("end_of_word_suffix") or "", byte_symbols()
        self._inner = np.array([vocab[s] for s in symbols], np.int64)
        self._last = np.array([vocab[s + end] for s in symbols], np.int64)
        self._rules: list[tuple[int, int, int]] = []  # by rank: left, right, merged
        born: dict[int, int] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            left, right = vocab[a], vocab[b]
            made = vocab[a + b]
            if born.get(left, -1) >= rank or born.get(right, -1) >= rank or made in born:
                raise ValueError("ranks can't be applied in ascending order: a token takes part in an earlier merge")
            born[made] = rank
            self._rules.append((left, right, made))
        self._rank = {left << 20 | right: r for r, (left, right, _) in enumerate(self._rules)}
        codes = np.array([*self._rank], np.int64)
        self._code_rank = np.argsort(codes)
        self._codes = codes[self._code_rank]
        self._special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self._split = re.compile("(" + "|".join(map(re.escape, self._special)) + ")") if self._special else None
        self.tokens = [""] * (max([*vocab.values(), *self._special.values()]) + 1)
        for token, i in [*vocab.items(), *self._special.items()]:
            self.tokens[i] = token
        self._memo_words = memo_words
        self._memo: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}  # the memo before the present one; what is used again moves over

    def words(self, text: str) -> list[str]:
        """The words that BPE runs on; special tokens stand for themselves behind a NUL."""
        if self._split and "<|" in text and (parts := self._split.split(text))[1:]:
            return [w for i, p in enumerate(parts) for w in (["\0" + p] if i % 2 else self.words(p))]
        if text.isascii() or _PLAIN.match(text):
            return _WORD.findall(text.lower())
        to_byte = _to_byte()
        cut = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(map(to_byte.__getitem__, w)).decode("utf-8", "surrogateescape") for w, _ in cut]

    def _layout(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All words in one array of symbols: symbols, next and previous places (-1: none), first places."""
        raw = [w.encode("utf-8", "surrogateescape") for w in words]
        ends = np.cumsum([len(x) for x in raw])
        starts = np.concatenate([[0], ends[:-1]])
        at = np.frombuffer(b"".join(raw), np.uint8)
        sym = self._inner[at]
        sym[ends - 1] = self._last[at[ends - 1]]
        after, before = np.arange(1, len(at) + 1), np.arange(-1, len(at) - 1)
        after[ends - 1] = before[starts] = -1
        return sym, after, before, starts

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, -1 where there is none."""
        codes = (left << 20) | right
        at = np.minimum(np.searchsorted(self._codes, codes), len(self._codes) - 1)
        return np.where(self._codes[at] == codes, self._code_rank[at], -1)

    def _apply(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, by the pair occurrence index.

        The lowest ranks have long lists, which are applied as arrays; the many short lists of the
        other ranks are applied place by place.
        """
        sym, after, before, starts = self._layout(words)
        index: dict[int, list[np.ndarray]] = {}

        def listed(places: np.ndarray, ranks: np.ndarray) -> None:
            places, ranks = places[ranks >= 0], ranks[ranks >= 0]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, p in zip(ranks[np.concatenate([[0], cuts])].tolist() if len(ranks) else [], np.split(places, cuts)):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(active, r)

        active: list[int] = []
        here = np.flatnonzero(after >= 0)
        listed(here, self._ranks(sym[here], sym[here + 1]))
        while active and active[0] < LONG_LISTS:
            rank = heapq.heappop(active)
            left, right, made = self._rules[rank]
            i = np.concatenate(index.pop(rank))
            i = i[(sym[i] == left) & (after[i] >= 0)]
            i = i[sym[after[i]] == right]
            if left == right:  # of overlapping places the leftmost counts
                taken: set[int] = set()
                i = np.array([p for p in np.unique(i).tolist() if int(before[p]) not in taken and not taken.add(p)], np.int64)
            if not len(i):
                continue
            j = after[i]
            k = after[j]
            sym[i], sym[j], after[i] = made, -1, k
            has = k >= 0
            before[k[has]] = i[has]
            h = before[i]
            h = h[h >= 0]
            i, k = i[has], k[has]
            places, first = np.unique(np.concatenate([i, h]), return_index=True)
            seconds = np.concatenate([k, after[h]])[first]
            listed(places, self._ranks(sym[places], sym[seconds]))
        lists = {r: np.concatenate(p).tolist() for r, p in index.items()}
        sym = self._apply_short(sym.tolist(), after.tolist(), before.tolist(), lists, active)
        ends = np.cumsum(np.add.reduceat(sym >= 0, starts, dtype=np.int64)) * 4
        flat, out, at = sym[sym >= 0].astype("<u4").tobytes(), [], 0
        for e in ends.tolist():
            out.append(flat[at:e])
            at = e
        return out

    def _apply_short(self, sym: list[int], after: list[int], before: list[int], index: dict[int, list[int]], active: list[int]) -> np.ndarray:
        rank_of, rules = self._rank.get, self._rules
        while active:
            rank = heapq.heappop(active)
            left, right, made = rules[rank]
            places = index.pop(rank)
            if left == right:
                places.sort()
            for i in places:
                if sym[i] != left or (j := after[i]) < 0 or sym[j] != right:
                    continue  # merged meanwhile
                sym[i], sym[j] = made, -1
                after[i] = k = after[j]
                if k >= 0:
                    before[k] = i
                    if (r := rank_of(made << 20 | sym[k], -1)) >= 0:
                        if r in index:
                            index[r].append(i)
                        else:
                            index[r] = [i]
                            heapq.heappush(active, r)
                if (h := before[i]) >= 0 and (r := rank_of(sym[h] << 20 | made, -1)) >= 0:
                    if r in index:
                        index[r].append(h)
                    else:
                        index[r] = [h]
                        heapq.heappush(active, r)
        return np.array(sym, np.int64)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        chunk: list[list[str]] = []
        size = 0
        for text in texts:
            chunk.append(self.words(text) if text else [])
            size += len(text or "")
            if size >= CHUNK_CHARS:
                yield from self._encode(chunk)
                chunk, size = [], 0
        yield from self._encode(chunk)

    def _encode(self, chunk: list[list[str]]) -> Iterator[bytes]:
        memo = self._memo
        if len(memo) > self._memo_words:
            self._older, self._memo = memo, (memo := {})
        new = set().union(*chunk).difference(memo)
        memo.update((w, self._older[w]) for w in new & self._older.keys())
        new.difference_update(memo)
        for w in [w for w in new if w[0] == "\0" and w[1:] in self._special]:
            memo[w] = int(self._special[w[1:]]).to_bytes(4, "little")
            new.discard(w)
        words = list(new)
        for at in range(0, len(words), AT_ONCE):
            memo.update(zip(part := words[at : at + AT_ONCE], self._apply(part)))
        get = memo.__getitem__
        for words in chunk:
            yield b"".join(map(get, words))

    def decode(self, ids: bytes | np.ndarray) -> str:
        """As the library decodes without a decoder: tokens with spaces between."""
        at = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
        return " ".join(map(self.tokens.__getitem__, at.tolist()))


@lru_cache(1)
def _to_byte() -> dict[str, int]:
    return {s: b for b, s in enumerate(byte_symbols())}


@lru_cache(2)
def load(spec: str, memo_words: int = MEMO_WORDS) -> Bpe:
    """One vocabulary in each Python worker."""
    return Bpe(spec, memo_words)


def spec_of(path: str) -> str:
    """The vocabulary file's text, read on the driver; a fixed few MB that travel to the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def map_texts(df: DataFrame, path: str, schema: str, make: Callable[[Bpe, dict[str, list], Iterator[bytes]], dict[str, list]], text: str = "text") -> DataFrame:
    """Rows of df with what ``make(bpe, columns, ids of each text)`` adds, batch by batch."""
    spec = df.sparkSession.sparkContext.broadcast(spec_of(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                columns = {n: part.column(n).to_pylist() for n in part.schema.names}
                made = make(bpe, columns, bpe.encode(columns[text]))
                yield pa.RecordBatch.from_pydict(made)

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, text: str = "text", into: str = "ids") -> DataFrame:
    """df with the ids of its text as ``array<int>``."""
    kept = df.drop(into)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", `{into}` array<int>"
    spec = df.sparkSession.sparkContext.broadcast(spec_of(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(spec.value)
        for batch in batches:
            ids = list(bpe.encode(batch.column(text).to_pylist()))
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, into])

    return kept.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the decoded text of its ids; null ids decode to the empty string."""
    kept = df.drop(into)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", `{into}` string"
    spec = df.sparkSession.sparkContext.broadcast(spec_of(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(spec.value)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], np.int64)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, into])

    return kept.mapInArrow(run, schema)


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: token count, digest of its ids, and digest of the text decoded from those ids."""
    from hashlib import sha256

    def make(bpe: Bpe, columns: dict[str, list], ids: Iterator[bytes]) -> dict[str, list]:
        out = {"doc_id": pa.array(columns["doc_id"], pa.int64()), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for x in ids:
            out["n_tokens"].append(len(x) // 4)
            out["ids_sha256"].append(sha256(x).hexdigest())
            out["decoded_sha256"].append(sha256(bpe.decode(x).encode()).hexdigest())
        return out | {"n_tokens": pa.array(out["n_tokens"], pa.int64())}

    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
