"""The n-gram Jaccard join against brute force."""

import random

import numpy as np
import pytest
from brute import shingles, similar_groups

from clausegrid.llm import ngram_join as nj

def corpus(seed, n=150, near=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    common = [rng.choice(vocab) for _ in range(60)]
    texts = []
    for _ in range(n):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 5, 6, 30, 80, 200]))]
        if rng.random() < 0.5:
            w[len(w) // 2 : len(w) // 2] = common
        texts.append(w)
    base = [rng.choice(vocab) for _ in range(120)]
    for _ in range(near):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(w)
    for _ in range(40):
        w = list(rng.choice(texts))
        if w and rng.random() < 0.7:
            w[rng.randrange(len(w))] = "Changed"
        texts.append(w)
    out = [rng.choice([" ", "\n", "\t ", "  "]).join(x.upper() if rng.random() < 0.1 else x for x in w) for w in texts]
    return out + [None, "", "  \n "]


@pytest.mark.parametrize("seed,common,sent", [(1, 256, 200_000), (2, 20, 0), (3, 4, 200_000), (4, 2, 0)])
def test_agrees_with_brute_force(spark, monkeypatch, seed, common, sent):
    monkeypatch.setattr(nj, "COMMON", common)
    monkeypatch.setattr(nj, "BROADCAST_COMMON", sent)
    monkeypatch.setattr(nj, "BLOCK", 16)
    rows = [(i * 7 % 1000, t) for i, t in enumerate(corpus(seed))]
    rows += [(None, rows[3][1]), (None, rows[160][1]), (rows[5][0], rows[5][1]), (rows[5][0], rows[200][1])]
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, row string")
    got = sorted((tuple(r) for r in nj.similar_documents(docs).collect()), key=repr)
    assert got == similar_groups(rows)


def test_one_of_each(spark):
    rows = [(i, t) for i, t in enumerate(corpus(9))]
    rows += [(2, rows[2][1]), (None, rows[170][1]), (None, None), (None, "only here a b c d e"), (None, "only here a b c d e")]
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, root long")
    kept = nj.one_of_each(docs)
    assert kept.columns == docs.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    comp = similar_groups(rows)
    with_words = {c for d, n, c in comp if n and c is not None}
    assert sorted(d for d, t in left if shingles(t) and d is not None) == sorted(with_words)
    assert sum(1 for d, t in left if d is None and shingles(t)) == 1
    assert sum(1 for d, t in left if not shingles(t)) == sum(1 for d, t in rows if not shingles(t))


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert nj.similar_documents(empty).count() == 0
    assert nj.one_of_each(empty).count() == 0


def test_tree_finds_what_the_bound_allows():
    rng = np.random.default_rng(5)
    counts = rng.poisson(3, (300, 64)).astype(np.int32)
    counts[200:] = counts[:100] + (rng.random((100, 64)) < 0.05)
    sizes = counts.sum(axis=1).astype(np.int64)
    q, p = nj.CountTree(counts, sizes).partners(counts, sizes)
    found = set(zip(q.tolist(), p.tolist()))
    want = {
        (i, j) for i in range(300) for j in range(300)
        if 5 * sizes[i] >= 4 * sizes[j] and 5 * sizes[j] >= 4 * sizes[i]
        and np.minimum(counts[i], counts[j]).sum() >= nj.needed(sizes[i] + sizes[j])
    }
    assert found == want


def test_tables_on_the_way_are_removed(spark, tmp_path, monkeypatch):
    import os

    from clausegrid.llm import common

    monkeypatch.setattr(common, "shared_folder", lambda spark, purpose: f"{tmp_path}/{purpose}-{len(os.listdir(tmp_path))}-{os.urandom(4).hex()}")
    monkeypatch.setattr(nj, "COMMON", 8)
    rows = list(enumerate(corpus(3)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in common.alone(spark, lambda: nj.similar_documents(docs), "result").collect()}
    assert len(found) == len(rows)
    assert {name.split("-")[0] for name in os.listdir(tmp_path)} == {"result"}
    # While it runs, entries, buckets and whole sets go as soon as what follows from them is written.
    members, roots = nj._linked(docs)
    left = {name.split("-")[0] for name in os.listdir(tmp_path)}
    assert not left & {"shared", "live", "common", "extra", "theirs", "buckets", "hopeful", "sets", "edges"}
    assert members.count() == len(rows) and roots.count()


def test_shuffle_files_go_with_the_query_that_made_them(spark):
    from clausegrid.llm.common import stored

    # What was shuffled before is none of this query's.
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = set(map(str, tracker.shuffleStatuses().keys().mkString(",").split(",")))
    counted = stored(spark.range(100_000).selectExpr("id % 1000 AS k").groupBy("k").count(), "counted")
    after = set(map(str, tracker.shuffleStatuses().keys().mkString(",").split(",")))
    assert after <= before and counted.count() == 1000
