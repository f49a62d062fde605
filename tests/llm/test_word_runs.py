"""Runs of words against a brute-force search over all periods and places."""

from hashlib import sha256

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from packetloom.llm import word_runs


def brute(words: list) -> list[tuple[int, int, int]]:
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            e = i + q
            smaller = any(all(words[k] == words[k + p] for k in range(s, e - p)) for p in range(1, q))
            if e - s >= max(6, 4 * q) and not smaller:
                out.append((s, e, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(words: list) -> list[tuple[int, int, int]]:
    return [tuple(r) for r in next(word_runs.detect([words])).tolist()]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b"]), max_size=90))
def test_two_words(words):
    assert found(words) == brute(words)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=7), st.integers(1, 7)), max_size=8))
def test_repeated_pieces(pieces):
    words = [w for piece, n in pieces for w in piece * n]
    assert found(words) == brute(words)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 9), st.integers(0, 9)), max_size=6))
def test_nested_repeats(parts):
    words: list[bytes] = []
    for n, times, keep in parts:
        words = (words[-n:] or [b"x"]) * times + words[:keep] + [b"%d" % n]
    assert found(words) == brute(words)


def test_many_documents_at_once_are_apart():
    documents = [[b"a"] * 5, [b"a"] * 6, [], [b"a", b"b"] * 4, [b"b", b"a"] * 3 + [b"c"], [b"x"], [b"a"] * 3]
    assert [[tuple(r) for r in x.tolist()] for x in word_runs.detect(documents)] == [brute(d) for d in documents]


def test_long_runs():
    assert found([b"word"] * 30_000) == [(0, 30_000, 1)]
    period = [b"%d" % i for i in range(7000)]
    assert found(period * 5 + period[:100]) == [(0, 35_100, 7000)]
    noise = [b"%d" % x for x in np.random.default_rng(3).integers(0, 3, 20_000)]
    assert [r for r in found(noise) if r[2] < 4] == [r for r in brute_short(noise)]


def brute_short(words):
    out = []
    for q in (1, 2, 3):
        same = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        s = None
        for i, x in enumerate(same):
            if x and s is None:
                s = i
            elif not x and s is not None:
                piece = words[s : i + q]
                if len(piece) >= max(6, 4 * q) and not any(all(a == b for a, b in zip(piece, piece[p:])) for p in range(1, q)):
                    out.append((s, i + q, q))
                s = None
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(r, tails: bool) -> tuple:
    words = (r.text or "").encode().split()
    if tails:
        words = word_runs.repeated_tail(words, r.doc_id)
    runs = brute(words) if len(words) < 1500 else found(words)
    best = min(runs, key=lambda x: (x[0] - x[1], x[0], x[2]), default=None)
    best = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return (r.doc_id, len(runs), *best, sha256(lines.encode()).hexdigest(), sha256(kept).hexdigest())


def test_table(docs, rows):
    got = {tuple(r) for r in word_runs.report(docs, tails=True).collect()}
    assert got == {expected(r, True) for r in rows} and any(g[1] for g in got)


def test_odd_rows_and_nothing(odd, none):
    got = sorted(map(tuple, word_runs.report(odd, tails=True).collect()), key=str)
    assert got == sorted((expected(r, True) for r in odd.collect()), key=str)
    assert word_runs.report(none).count() == 0


def test_tail_is_periodic():
    words = [b"%d" % i for i in range(1000)]
    for doc in range(200):
        made = word_runs.repeated_tail(words, doc)
        assert len(made) == 1000
        if made != words:
            a = next(i for i in range(1000) if made[i] != words[i])
            assert made[a] == words[a - (p := a - words.index(made[a]))] and all(made[i] == made[i - p] for i in range(a, 1000))


def test_collapse_rewrites_only_texts_with_runs(spark, odd):
    out = sorted(map(tuple, word_runs.collapse(odd).select("doc_id", "text").collect()), key=str)
    want = []
    for r in odd.collect():
        words = (r.text or "").encode().split()
        runs = found(words)
        want.append((r.doc_id, word_runs.collapsed(words, np.array(runs)).decode() if runs else r.text))
    assert out == sorted(want, key=str) and word_runs.collapse(odd).columns == odd.columns
