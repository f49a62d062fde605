import struct
from collections import Counter
from hashlib import sha256
from statistics import mean

import pytest
import regex
import xxhash

from packetloom.llm import imatch


def brute_edits(rows):
    order = sorted(rows, key=lambda r: (r.doc_id is None, -(r.doc_id or 0)))
    out = {}
    for r, after in zip(order, order[1:] + order[:1]):
        text, k = r.text or "", len(r.text or "") // 3
        edit = (text[: len(text) - k]) + (after.text or "")[:k]
        out[r.doc_id] = (len(text), sha256(edit.encode()).hexdigest())
    return out


@pytest.mark.parametrize("blocks", [1, 7, 60])
def test_edits_and_fingerprints(docs, rows, blocks):
    got = imatch.fingerprints(docs, blocks=blocks).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == brute_edits(rows)
    by_id = {r.doc_id: r for r in got}
    prints = {r.text: by_id[r.doc_id].fingerprint for r in rows}
    assert all(by_id[r.doc_id].fingerprint == prints[r.text] for r in rows)
    assert all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    long = [r for r in got if r.n_chars > 300]
    assert mean(r.near_edited for r in long) > 0.3 > 0.1 > mean(r.near_next for r in long)


def test_blocks_make_no_difference(docs):
    assert sorted(map(str, imatch.fingerprints(docs, blocks=3).collect())) == sorted(map(str, imatch.fingerprints(docs, blocks=50).collect()))


def test_odd_rows(odd, none, spark):
    got = imatch.fingerprints(odd).collect()
    assert len(got) == odd.count()
    same = {r.fingerprint for r in got if r.doc_id in (3, 4)}
    assert len(same) == 1
    assert imatch.fingerprints(none).count() == 0
    one = imatch.fingerprints(odd.filter("doc_id = 3")).collect()
    assert one[0].near_next == 1.0 and one[0].n_chars == 27


def test_copies_of_a_text_keep_their_terms(spark, docs, rows):
    """A text with over 64 terms whose copies are a third of the rows: its lexicon and likeness stay."""
    hot = next(r for r in sorted(rows, key=lambda r: r.doc_id) if len(set((r.text or "").lower().split())) > 100)
    copies = spark.createDataFrame([(10_000 + i, hot.text, hot.n_chars) for i in range(100)], "doc_id long, text string, n_chars long")
    mixed = docs.select("doc_id", "text", "n_chars").union(copies)
    terms = lambda df: {r.term for r in imatch.lexicon(df).collect()}
    assert terms(mixed) == terms(docs)
    got = [r for r in imatch.fingerprints(mixed).collect() if r.doc_id >= 10_000]
    assert len(got) == 100 and all(r.near_edited > 0 for r in got)


def test_a_text_outside_the_band_uses_all_its_terms(spark):
    text = " ".join(f"w{i}" for i in range(200))
    df = spark.createDataFrame([(i, f"{text} {i}") for i in range(300)], "doc_id long, text string")
    got = imatch.fingerprints(df, rarest=0.5, commonest=0.6).collect()
    assert all(len(r.fingerprint) == 256 and r.near_edited > 0 for r in got)


def plain_prints(texts, lexicon):
    """Fingerprints by their definition: sorted hashes of the terms in each subset, hashed one after the other."""
    out = {}
    for text in texts:
        own = {xxhash.xxh64_intdigest(t.encode(), 42) for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t}
        own = own & lexicon or own
        slots = ["----"] * 64
        for level, bits in enumerate((4, 6, 8, 10)):
            for i in range(16):
                held = sorted(h - (1 << 64) if h >> 63 else h for h in own if (h >> 13 * level) % (1 << bits) == i)
                digest = 42
                for h in held:
                    digest = xxhash.xxh64_intdigest(struct.pack("<q", h), digest)
                if held:
                    slots[16 * level + i] = f"{digest & 0xFFFF:04x}"
        out[text] = slots if own else ["x" + sha256(text.encode()).hexdigest()[:16]]
    return out


def plain_likeness(a, b):
    if a == b:
        return 1.0
    best = 0.0
    for level in range(4):
        pairs = list(zip(a[16 * level : 16 * level + 16], b[16 * level : 16 * level + 16]))
        held = sum((x, y) != ("----", "----") for x, y in pairs)
        best = max(best, sum(x == y != "----" for x, y in pairs) / max(held, 4))
    return best


def test_fingerprints_and_likenesses_by_definition(docs, rows):
    df = Counter()
    for text in {r.text or "" for r in rows}:
        df.update({xxhash.xxh64_intdigest(t.encode(), 42) for t in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if t})
    n = len({r.text or "" for r in rows})
    lexicon = {t for t, k in df.items() if max(1, n / 1000) <= k <= max(1, n / 50)}
    order = sorted(rows, key=lambda r: -r.doc_id)
    after = {r.doc_id: s.text or "" for r, s in zip(order, order[1:] + order[:1])}
    texts = {r.doc_id: r.text or "" for r in rows}
    edits = {d: t[: len(t) - len(t) // 3] + after[d][: len(t) // 3] for d, t in texts.items()}
    prints = plain_prints({*texts.values(), *edits.values()}, lexicon)
    for r in imatch.fingerprints(docs).collect():
        own, edit, then = (prints[t] for t in (texts[r.doc_id], edits[r.doc_id], after[r.doc_id]))
        assert (r.fingerprint, r.edited_fingerprint) == ("".join(own), "".join(edit))
        assert abs(r.near_edited - plain_likeness(own, edit)) < 1e-12 and abs(r.near_next - plain_likeness(own, then)) < 1e-12
