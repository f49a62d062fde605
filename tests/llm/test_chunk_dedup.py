import random
import re
from collections import defaultdict
from hashlib import sha256

from packetloom.llm import chunk_dedup


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")].append(r)
    out = []
    for text, own in groups.items():
        best = min(own, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        staying = [r.doc_id == best.doc_id and len(r.text or "") == len(best.text or "") for r in own]
        first = staying.index(True)
        out += [(r.doc_id, best.doc_id, len(own), i == first, sha256(text.encode()).hexdigest()) for i, r in enumerate(own)]
    return sorted(out, key=str)


def test_documents_and_odd_rows(docs, rows, odd, none):
    for df in (docs, odd):
        assert sorted((tuple(r) for r in chunk_dedup.dedup(df).collect()), key=str) == brute(df.collect())
    assert chunk_dedup.dedup(none).count() == 0


def test_clashing_hashes_are_told_apart(docs, rows):
    assert sorted((tuple(r) for r in chunk_dedup.dedup(docs, bits=3).collect()), key=str) == brute(rows)


def test_chunks_follow_content():
    draw = random.Random(7)
    data = bytes(draw.randrange(97, 123) for _ in range(300_000))
    own = chunk_dedup.chunks(data)
    assert b"".join(own) == data and max(map(len, own)) <= chunk_dedup.MOST
    moved = chunk_dedup.chunks(b"something else in front" + data)
    assert len(set(own) & set(moved)) > 0.8 * len(own)
    assert b"".join(chunk_dedup.chunks(b"a" * 100_000)) == b"a" * 100_000
