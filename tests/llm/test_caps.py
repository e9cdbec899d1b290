"""Spherical-cap filters against brute force."""

import numpy as np
import pytest

from clausegrid.llm import caps


def brute(ids, vectors):
    usable = [v is not None and None not in v and all(np.isfinite(v)) and any(v) for v in vectors]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if u else None for v, u in zip(vectors, usable)]
    root, links = list(range(len(ids))), [0] * len(ids)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = set()
    for i in range(len(ids)):
        for j in range(i):
            if usable[i] and usable[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95:
                pairs.add((j, i))
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, links[i], least.get(find(i)) if usable[i] else d) for i, d in enumerate(ids)], pairs


def test_given_vectors_with_near_copies(spark):
    """The given vectors have no near ones at this size, so some are planted at a cosine of about 0.96."""
    given = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    rng = np.random.default_rng(3)
    planted = []
    for i, (_, v) in enumerate(given[:200]):
        v, z = np.array(v), rng.normal(size=len(v))
        z -= (z @ v) / (v @ v) * v
        planted.append((1000 + i, [float(x) for x in v + 0.29 * np.linalg.norm(v) * z / np.linalg.norm(z)]))
    rows = given + planted
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, pairs = brute([d for d, _ in rows], [v for _, v in rows])
    assert len(pairs) >= 200
    got = {r.vec_id: r for r in caps.near_vectors(frame).collect()}
    assert all(got[d].n_links <= n for d, n, _ in want)
    assert sum(r.n_links for r in got.values()) >= 0.99 * 2 * len(pairs)
    assert sum(got[d].component_id == c for d, _, c in want) >= 0.99 * len(want)
    assert all(r.kept == (r.component_id == r.vec_id) for r in got.values())


@pytest.mark.parametrize("block", [1024, 8])
def test_odd_vectors_and_hot_groups(spark, monkeypatch, block):
    monkeypatch.setattr(caps, "BLOCK", block)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=16)
    vectors = [list(map(float, centre + 0.05 * rng.normal(size=16))) for _ in range(60)]
    vectors += [list(map(float, rng.normal(size=16))) for _ in range(40)]
    vectors += [vectors[0]] * 5 + [[2 * x for x in vectors[70]], [1e-200 * x for x in vectors[71]]]
    vectors += [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 0.0], [1.0, 0.01], [3.0]]
    ids = [1000 - i for i in range(len(vectors))]
    ids[3], ids[7], ids[9] = None, None, ids[8]
    frame = spark.createDataFrame([(d, v, 1, "x") for d, v in zip(ids, vectors)], "vec_id long, embedding array<double>, copies int, row string")
    want, _ = brute(ids, vectors)
    got = [(r.vec_id, r.n_links, r.component_id) for r in caps.near_vectors(frame).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert caps.near_vectors(frame.limit(0)).count() == 0


@pytest.mark.parametrize("dim,n", [(12, 300), (9, 5_000), (64, 20_000)])
def test_decoding_lists_the_best_filters(dim, n):
    code = caps.ProductCode(dim, n)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vector, word = code.filters(x)
    turned = x @ code.rotation
    for v in range(20):
        scores = np.zeros(1)
        for part, c in zip(code.parts, code.codes):
            scores = (scores[:, None] + (c @ turned[v, part])[None, :]).ravel()
        best = np.argsort(-scores)[: caps.FILTERS]
        assert set(word[vector == v].tolist()) == set(best.tolist())


@pytest.mark.parametrize("n,least", [(2_000, 0.99), (50_000, 0.99), (1_000_000, 0.99), (100_000_000, 0.97)])
def test_recall_of_pairs_at_the_limit(n, least):
    """Pairs of cosine 0.95 to 0.955, in codes for n vectors: at least one filter in common."""
    rng, m = np.random.default_rng(7), 500
    a = rng.normal(size=(m, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = rng.normal(size=(m, 64))
    z -= (z * a).sum(axis=1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    c = rng.uniform(0.95, 0.955, size=(m, 1))
    lists = []
    for x in (a, c * a + np.sqrt(1 - c * c) * z):
        vector, word = caps.product_code(64, n).filters(x)
        lists.append([set(word[vector == v].tolist()) for v in range(m)])
    assert sum(bool(p & q) for p, q in zip(*lists)) >= least * m
