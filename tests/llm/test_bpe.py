"""Encoding and decoding against the public tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clausegrid.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def ours(texts):
    encoder = bpe._Encoder(bpe.vocabulary(PATH))
    packed = encoder.flush([encoder.numbers(t) for t in texts])
    return [np.frombuffer(p, "<u4").tolist() for p in packed]


CASES = [
    "", " ", "a", "aaaa aaaaaaa", "Hello world's  end\n\n\tof it'll  ", "x<|endoftext|><|endoftext|> y", "<|endoftext|>",
    "naïve Straße 日本語 🎉🎉 ñandú", "՘֋\U000107bb1₏", "\x00\x01\x85\x1c a　b​", "1234567890" * 9, "ab" * 3000, "!" * 999,
]


def test_cases(library):
    assert ours(CASES) == [library.encode(t, add_special_tokens=False).ids for t in CASES]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(texts):
    library = Tokenizer.from_file(PATH)
    assert ours(texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_character_splits_alike(library):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}{c}1 {c} x" for c in chars[i : i + 4096]) for i in range(0, len(chars), 4096)]
    split = library.pre_tokenizer.pre_tokenize_str
    for text in texts:
        assert [text[a:b] for _, (a, b) in split(text)] == bpe.vocabulary(PATH).split(text)


def test_rows(spark, library):
    rng = random.Random(3)
    texts = [*CASES, None, *["".join(rng.choice("the anié \n<|>0") for _ in range(500)) for _ in range(30)]]
    rows = [(i % 40 if i else None, t, f"s{i}", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH).collect())
    want = []
    for i, text, _, _ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert got == sorted(want)


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_decode_of_broken_ids(spark):
    one = np.array([bpe.vocabulary(PATH).byte_id[0xC3], 4_000_000], "<u4").tobytes()
    rows = spark.createDataFrame([(1, bytearray(one)), (2, None), (3, bytearray())], "doc_id long, ids binary")
    assert {r.doc_id: r.decoded for r in bpe.decode(rows, PATH).collect()} == {1: "�", 2: "", 3: ""}
