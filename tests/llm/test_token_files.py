"""Token files against the library, document by document, and the coding by exact round trips."""

from zlib import crc32

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from packetloom.llm import token_files
from packetloom.llm.io import shared_dir

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


def brute(rows) -> list[tuple]:
    library, out, start = Tokenizer.from_file(PATH), [], 0
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        out.append((r.doc_id, start, len(ids), crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def got(df) -> list[tuple]:
    return sorted((tuple(r)[:4] for r in df.collect()), key=lambda r: r[1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50_256), st.integers(0, (1 << 64) - 1)), max_size=300))
def test_words_hold_any_values(values):
    a = np.array(values, np.uint64)
    words, whole = token_files.pack(a)
    assert token_files.unpack(words, whole).tolist() == values
    assert len(whole) == sum(v >= 1 << 60 for v in values)


def test_a_word_takes_the_most_that_fit():
    for count, width in token_files.WIDTHS.values():
        words, whole = token_files.pack(np.full(count * 3, (1 << width) - 1, np.uint64))
        assert len(words) == 3 and not len(whole)


def test_blocks_are_read_by_themselves():
    ids, w = np.random.default_rng(1).integers(0, 50_257, 1000).astype(np.uint32), token_files.Writer(block=64)
    for at in range(0, 1000, 100):
        w.add(at, ids[at : at + 100])
    r = token_files.Reader(w.data())
    assert len(r.tables) == 16 and all(r.block(k).tolist() == ids[64 * k : 64 * k + 64].tolist() for k in (15, 3, 0))
    assert [(d, s, x.tolist()) for d, s, x in r.documents()] == [(at, at, ids[at : at + 100].tolist()) for at in range(0, 1000, 100)]


def test_spoilt_files_are_refused():
    w = token_files.Writer()
    w.add(7, np.arange(50, dtype=np.uint32))
    data = w.data()
    for bad in (data[:20], data[:-8], data[:-1], b"x" + data[1:], data[:-1] + bytes([data[-1] ^ 1])):
        with pytest.raises(token_files.FileError):
            list(token_files.Reader(bad).documents())


def test_files_are_the_librarys_ids_in_order(spark, docs, rows):
    assert got(token_files.round_trip(docs, PATH)) == brute(rows)


def test_many_small_files_in_many_tasks(spark, docs, rows):
    assert got(token_files.round_trip(docs.repartition(7), PATH, file_ids=5000, block=1000)) == brute(rows)


def test_ids_come_back(spark, docs, rows):
    folder = f"{shared_dir(spark)}/token-test"
    manifest = token_files.write_files(docs, folder, PATH, file_ids=100_000).collect()
    back = {r.doc_id: r.ids for r in token_files.read_files(spark, folder).collect()}
    library = Tokenizer.from_file(PATH)
    assert sum(m.docs for m in manifest) == len(rows) and sum(m.n_tokens for m in manifest) == sum(map(len, back.values()))
    assert all(back[r.doc_id] == [*library.encode(r.text, add_special_tokens=False).ids, 0] for r in rows)


def test_odd_rows(odd):
    have, want = got(token_files.round_trip(odd, PATH)), brute(odd.collect())
    assert sorted(h[2:] for h in have) == sorted(w[2:] for w in want)
    assert [h[0] for h in have] == [w[0] for w in want]
    assert all(a[1] + a[2] == b[1] for a, b in zip(have, have[1:])) and have[0][1] == 0


def test_nothing(none):
    assert token_files.round_trip(none, PATH).count() == 0


def test_texts_of_every_kind_are_encoded_as_by_the_library():
    texts = ["it's  we'll\n\n x   y\t", "  lead", "trail  ", "\x1c \x1d a\x85b", "é è ²3 ½x", "中文 text", "a<|endoftext|>b", "'s's ''re", " 　x", "ſt ŉ ĸ Ÿ", "0123 a1b2", "", "\n", "..'s", "İ"]
    own, library = token_files.Encoder(token_files.spec_of(PATH)), Tokenizer.from_file(PATH)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_encoded_together_are_those_encoded_alone():
    own = token_files.Encoder(token_files.spec_of(PATH))
    pieces = [" a", " '", " s", " 12", " ½", " é", " ...", " \x00", " x\x01", " zebra", " '!", "'s", "a", " ", "  ", "\n", " Ġ", " ~"] * 1
    whole = own._whole(pieces)
    assert dict(own._pieces(pieces)) == dict(zip(pieces, whole))
