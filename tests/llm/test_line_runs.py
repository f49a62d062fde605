import random

import pytest

from packetloom.llm import line_runs


def brute(rows, min_lines, min_words):
    """Every run of every document against all earlier runs."""
    docs = {}
    for r in rows:
        docs[r.doc_id is None, r.doc_id or 0, r.text or ""] = (r.text or "").split("\n")
    seen, out = set(), {}
    for key in sorted(docs):
        own, gone = docs[key], set()
        for i in range(len(own)):  # starts in order, so what is seen lies earlier
            for j in range(len(own), i, -1):
                run = tuple(own[i:j])
                if len(run) >= min_lines and sum(len(x.split()) for x in run) >= min_words and run in seen:
                    gone.update(range(i, j))
                    break
            seen.update(tuple(own[i:j]) for j in range(i + 1, len(own) + 1))
        out[key] = gone
    return docs, out


def check(df, min_lines, min_words):
    rows = df.collect()
    docs, gone = brute(rows, min_lines, min_words)
    want = []
    for r in rows:
        key = (r.doc_id is None, r.doc_id or 0, r.text or "")
        cut = sorted(gone[key])
        left = "\n".join(x for i, x in enumerate(docs[key]) if i not in gone[key])
        want.append((r.doc_id, len(docs[key]), len(cut), ",".join(map(str, cut)), left))
    got = [tuple(r) for r in line_runs.report(df, min_lines, min_words).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("min_lines,min_words", [(1, 3), (3, 0), (2, 9), (1, 0)])
def test_random_line_sequences(spark, min_lines, min_words):
    draw = random.Random(min_lines * 10 + min_words)
    bits = ["", "a", "b b", "c c c", "d d d d d", " "]
    rows = [(i, "\n".join(draw.choice(bits) if draw.random() < 0.8 else f"own {draw.random()}" for _ in range(draw.randint(0, 14)))) for i in range(40)]
    rows += [(100 + i, "\n".join(["x one"] * i + ["a", "", "b b"] * 3)) for i in range(6)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), min_lines, min_words)


def test_documents_and_odd_rows(docs, odd, none):
    check(docs.filter("length(text) < 4000"), 1, 3)
    check(odd, 1, 3)
    assert line_runs.report(none).count() == 0


def test_columns_are_kept(odd):
    out = line_runs.cut(odd)
    assert out.schema.names == odd.schema.names and out.count() == odd.count()
    for r in out.filter("doc_id = 8").collect():
        assert r.text == "line one is here\nline two is here\n" and r.n_chars == len(r.text)


def test_long_runs_are_reported_whole(spark):
    """100 lines that come again, once in full, once from the middle: two maximal runs, each with its first place."""
    passage = [f"line {i} of the passage" for i in range(100)]
    texts = ["\n".join(["own a", *passage, "own b"]), "\n".join([*passage, "own c"]), "\n".join(["own d", *passage[40:70], "own e", "", "x"])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r._doc, r.start, r.len, r.words, r["first"]._doc, r["first"].pos) for r in line_runs.runs(df).collect())
    assert got == [(1, 0, 100, 500, 0, 1), (2, 1, 30, 150, 0, 41)]
    check(df, 1, 3)


def test_growing_versions(spark):
    """Each version begins with the one before: every longest prefix is another length."""
    texts = ["\n".join(f"step {i} is done" for i in range(3 * k + 1)) + f"\nend of {k}" for k in range(12)]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 1, 3)


def test_clashing_columns_are_kept(spark):
    names = ["_text", "_hash", "_doc", "_none", "_lines", "_dels", "row"]
    df = spark.createDataFrame([(i, "a line of words\nown %d" % i, *(f"{c}{i}" for c in names)) for i in range(3)], ["doc_id", "text", *names])
    out = line_runs.cut(df)
    assert out.columns == df.columns
    for r in out.collect():
        assert [r[c] for c in names] == [f"{c}{r.doc_id}" for c in names]
        assert r.text == ("a line of words\nown 0" if r.doc_id == 0 else f"own {r.doc_id}")
