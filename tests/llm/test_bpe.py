import random
from hashlib import sha256

import numpy as np
import pytest
from tokenizers import Tokenizer

from packetloom.llm import bpe
from packetloom.llm.queries import vocabulary

PATH = vocabulary()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.Bpe(bpe.spec_of(PATH))


def same(library, own, texts):
    for text, ids in zip(texts, own.encode(texts), strict=True):
        said = library.encode(text or "", add_special_tokens=False)
        assert np.frombuffer(ids, "<u4").tolist() == said.ids, repr(text)
        assert own.decode(ids) == library.decode(said.ids, skip_special_tokens=False), repr(text)


def test_every_plain_character_as_the_library(library, own):
    chars = [chr(i) for i in range(0x180)]
    same(library, own, chars + ["'" + c for c in chars] + [c + "a" for c in chars])


def test_random_texts_as_the_library(library, own):
    draw = random.Random(1)
    chars = [chr(i) for i in range(0x180)] + list("İſKΣ́ė 　​中\U0001f600٠½")
    same(library, own, ["".join(draw.choice(chars) for _ in range(draw.randint(0, 14))) for _ in range(5000)])
    same(library, own, ["".join(draw.choice("ab'st ") for _ in range(draw.randint(0, 40))) for _ in range(3000)])


def test_special_tokens_and_long_words(library, own):
    same(library, own, ["a<|endoftext|>b", "<|startoftext|><|x", "\0<|endoftext|>", "aaaa" * 5000, "abc" * 4000, "", None])


def test_memo_turns_over(own, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 10)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 50)
    texts = ["some words that come again and again", "and other words", "some words that come again"] * 5
    expected = list(bpe.Bpe(bpe.spec_of(PATH)).encode(texts))
    assert list(own.encode(texts)) == expected


def test_query_as_the_library(library, docs, rows, odd, none):
    for df in (docs, odd):
        got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip_digests(df, PATH).collect()}
        want = set()
        for r in df.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            decoded = library.decode(ids, skip_special_tokens=False)
            want.add((r.doc_id, len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256(decoded.encode()).hexdigest()))
        assert got == want
    assert bpe.round_trip_digests(none, PATH).count() == 0


def test_columns_encode_and_decode(library, odd):
    out = bpe.decode(bpe.encode(odd, PATH), PATH)
    assert {"ids", "decoded", "source", "rid"} <= set(out.columns)
    for r in out.collect():
        assert list(r.ids) == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == library.decode(list(r.ids), skip_special_tokens=False)
