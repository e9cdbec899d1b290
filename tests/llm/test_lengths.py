"""Suffix sums of the length histogram against direct sums."""

import random

import public_tokenizers
from tokenizers import Tokenizer

from clausegrid.llm import lengths

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_context_totals(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0, 1, 5, 1023, 1024, 2047, 5000, rng.randrange(9000)])) for _ in range(400)]
    frame = spark.createDataFrame(rows, "k string, length long")
    totals = lengths.context_totals(lengths.length_histogram(frame, ("k",)), ("k",)).cache()
    for r in totals.collect():
        own = [n for k, n in rows if k == r.k]
        assert r.n_docs == own.count(r.length) and r.total_docs == len(own) and r.total_tokens == sum(own)
        assert r.docs_longer == sum(n > r.length for n in own)
        assert r.truncated_tokens == sum(min(n, r.length) for n in own)
        assert abs(r.share_within - sum(n <= r.length for n in own) / len(own)) < 1e-12
    for limit in (0, 3, 1024, 2500, 10_000):
        got = {r.k: r.tokens for r in lengths.truncated_at(totals, limit, ("k",)).collect()}
        assert got == {k: sum(min(n, limit) for j, n in rows if j == k) for k in ("a", "b", None)}
    for share in (0.1, 0.5, 1.0):
        for r in lengths.quantile(totals, share, ("k",)).collect():
            own = sorted(n for k, n in rows if k == r.k)
            assert r.length == next(n for i, n in enumerate(own) if sum(m <= n for m in own) / len(own) >= share)


def test_lengths_are_the_library_s(spark):
    texts = ["", None, "Hello  world", "é" * 50, "a b c " * 1000, "<|endoftext|>x", "Hello  world"]
    frame = spark.createDataFrame([(t, 1, i) for i, t in enumerate(texts)], "text string, length int, ids int")
    library = Tokenizer.from_file(PATH)
    want = sorted(len(library.encode(t or "", add_special_tokens=False).ids) for t in texts)
    assert sorted(r.length for r in lengths.encoded_lengths(frame, PATH).collect()) == want
    empty = lengths.encoded_lengths(frame.limit(0), PATH)
    assert lengths.context_totals(lengths.length_histogram(empty)).count() == 0
