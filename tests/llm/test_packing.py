import random
from collections import defaultdict
from zlib import crc32

import numpy as np
from tokenizers import Tokenizer

from packetloom.llm import packing
from packetloom.llm.queries import vocabulary

PATH = vocabulary()


def test_differencing_is_near_equal():
    draw = random.Random(3)
    for _ in range(50):
        sizes = [draw.randint(1, 2000) for _ in range(draw.randint(50, 300))]
        k = max(1, sum(sizes) // 2048)
        windows = packing.difference(sizes, k)
        loads = [sum(sizes[i] for i in w) for w in windows]
        assert len(windows) == k and sorted(i for w in windows for i in w) == list(range(len(sizes)))
        if len(sizes) > 4 * k:
            assert max(loads) - min(loads) < 100


def test_textbook_two_way():
    windows = packing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in windows) == [14, 16]


def test_count_rises_until_all_fit():
    windows = packing.pack_block([60, 60, 60, 60], 100, cut=False)
    assert len(windows) == 4
    draw = random.Random(4)
    sizes = [draw.randint(1, 100) for _ in range(60)]
    windows = packing.pack_block(sizes, 100, cut=False)
    assert sorted(p[0] for w in windows for p in w) == list(range(60))
    assert max(sum(p[2] for p in w) for w in windows) <= 100


def test_cuts_leave_no_padding():
    draw = random.Random(5)
    for n in (1, 2, 3, 50, 400):
        sizes = [draw.randint(1, 127) for _ in range(n)]
        windows = packing.pack_block(sizes, 128)
        for w in windows:
            load = sum(p[2] for p in w)
            assert load == 128 or (load < 128 and load & (load - 1) == 0)
        for i in range(n):
            own = sorted(p[1:] for w in windows for p in w if p[0] == i)
            assert [s for s, _ in own] == [sum(x for _, x in own[:k]) for k in range(len(own))] and sum(x for _, x in own) == sizes[i]


def check(df, capacity=2048):
    library = Tokenizer.from_file(PATH)
    ids = [(r.doc_id, library.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in df.collect()]
    pieces = packing.pack(df, PATH).collect()
    windows = defaultdict(list)
    for p in pieces:
        windows[p.sequence_id].append(p)
    for w in windows.values():
        at = 0
        for p in sorted(w, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == capacity or at & (at - 1) == 0 and at < capacity
    want = defaultdict(int)
    for doc, x in ids:
        want[doc] += len(x)
    got = defaultdict(int)
    for p in pieces:
        got[p.doc_id] += p.length
    assert got == want
    once = {d: x for d, x in ids if sum(e == d for e, _ in ids) == 1}
    for p in pieces:
        if p.doc_id in once:
            own = once[p.doc_id]
            assert p.doc_tokens == len(own) and p.ids_crc32 == crc32(np.array(own[p.start : p.start + p.length], "<u4").tobytes())


def test_pieces_of_documents(docs):
    check(docs)


def test_odd_rows(odd, none):
    check(odd)
    assert packing.pack(none, PATH).count() == 0


def test_blocks_hand_on_what_does_not_fill_a_window(docs):
    from pyspark.sql import functions as F

    one = docs.coalesce(1)
    short = packing.pack(one, PATH, block=16).groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n < 2048").collect()
    assert len(short) <= 11 and len({r.n for r in short}) == len(short)
    check_blocks = packing.pack(one, PATH, block=16)
    assert check_blocks.agg(F.sum("length")).first()[0] == packing.pack(one, PATH).agg(F.sum("length")).first()[0]


def test_single_items_are_put_in_place_without_a_sort():
    class Counted(int):
        compared = 0

        def __lt__(self, other):
            Counted.compared += 1
            return int(self) < int(other)

    draw = random.Random(6)
    sizes = [draw.randint(1, 2047) for _ in range(600)]
    windows = packing.difference([Counted(s) for s in sizes], 300)
    assert Counted.compared < 600 * 20  # before: 300 to a merge
    assert sorted(i for w in windows for i in w) == list(range(600)) and windows == packing.difference(sizes, 300)


def test_fewer_kept_words_and_smaller_batches_make_the_same_rows(docs):
    one, by = docs.coalesce(1), ("sequence_id", "offset")
    assert packing.pack(one, PATH, memo_words=50, at_once=7).orderBy(*by).collect() == packing.pack(one, PATH).orderBy(*by).collect()


def test_kept_words_have_a_bound(rows):
    from packetloom.llm import bpe

    model = bpe.Bpe(bpe.spec_of(PATH), memo_words=100)
    for r in rows[:200]:
        list(model.encode([r.text]))
        own = len(set(model.words(r.text or "")))
        assert len(model._memo) <= 100 + own
