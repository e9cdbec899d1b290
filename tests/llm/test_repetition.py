"""Periodic runs against a brute-force version, on small texts, long ones and odd tables."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from clausegrid.llm import repetition as R

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_runs(w):
    """Every lag, every stretch of matches; the smallest period by trying all."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            s = i - q
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            smaller = any(all(w[k] == w[k - p] for k in range(s + p, i)) for p in range(1, q))
            if i - s >= max(6, 4 * q) and not smaller:
                out.append((s, i - s, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = brute_runs(w)
    best = (None,) * 4
    for s, length, q in runs:
        if best[0] is None or length * best[2] > best[1] * q:
            best = (s, length, q, 1000 * length // q)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *best, sha(lines), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_repeats_and_repeats_of_repeats(spark):
    rng = random.Random(3)
    rows = [(None, "a a a a a a"), (None, "a a a a a a"), (1, None), (2, ""), (3, " \t"), (4, "a b " * 40 + "c " * 9), (5, "x " * 5), (6, "x " * 6), (7, "é b " * 6)]
    for i in range(10, 400):
        block = [rng.choice("abcd") for _ in range(rng.randrange(1, 7))]
        mixed = [rng.choice("ab") for _ in range(rng.randrange(20))] + block * rng.randrange(9) + block[: rng.randrange(6)]
        rows.append((i, " ".join(mixed * rng.randrange(1, 6))))
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, runs string, n_words int")
    got = R.run_digest(R.find_runs(R.with_planted_runs(df))).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted((brute(*r) for r in rows), key=repr)
    assert sum(r.n_runs for r in got) > 100


def test_several_batches_of_one_task(spark):
    before, R.TOGETHER = R.TOGETHER, 40
    try:
        texts = [["a", "b"] * k for k in range(30)]
        assert [r.tolist() for r in R.word_runs(texts)] == [[list(x) for x in brute_runs(t)] for t in texts]
    finally:
        R.TOGETHER = before


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=40), max_size=4))
def test_any_texts(texts):
    assert [[tuple(x) for x in r.tolist()] for r in R.word_runs(texts)] == [brute_runs(t) for t in texts]


def test_long_texts_stay_fast():
    rng = random.Random(1)
    for words in (["a"] * 300_000, [rng.choice("ab") for _ in range(300_000)], ["a", "b", "c"] * 90_000 + ["d"], [str(i) for i in range(300_000)]):
        start = time.time()
        runs = R.word_runs([words])[0]
        assert time.time() - start < 20
        for s, length, q in runs[np.argsort(-runs[:, 1])][:50].tolist():
            assert all(words[k] == words[k - q] for k in range(s + q, s + length))
    assert R.word_runs([["a"] * 300_000])[0].tolist() == [[0, 300_000, 1]]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert R.run_digest(R.find_runs(R.with_planted_runs(df))).count() == 0
