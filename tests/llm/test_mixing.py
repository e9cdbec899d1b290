"""The mix against a brute-force version, on odd tables."""

import hashlib
import re
from collections import defaultdict

import pytest

from clausegrid.llm import mixing

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(rows):
    sizes = [len(WORD.findall(t or "")) for _, t, _ in rows]
    total = defaultdict(int)
    for (_, _, s), n in zip(rows, sizes):
        total[s] += n
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + ([None] if None in total else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped, left = set(), 1.5 * sum(total.values())
    while True:
        among = sum(weight[s] for s in order if s not in capped)
        now = {s for s in order if s in capped or (among and weight[s] * left / among > 2 * total[s])}
        if now == capped:
            break
        capped, left = now, 1.5 * sum(total.values()) - sum(2 * total[s] for s in now)
    target = {s: 2.0 * total[s] if s in capped or not among else weight[s] * left / among for s in order}
    key = lambda i: hashlib.md5(f"mix-{'' if rows[i][0] is None else rows[i][0]}".encode()).hexdigest()
    taken = {}
    for s in order:
        mine = sorted((i for i in range(len(rows)) if rows[i][2] == s), key=lambda i: (key(i), sizes[i]))
        budget = int(target[s])
        again = budget // total[s] if total[s] else 0
        rest = budget - again * total[s]
        for i in mine:
            part = min(sizes[i], max(0, rest))
            taken[i] = again * sizes[i] + part
            rest -= part
    return sorted(((rows[i][0], sizes[i], total[rows[i][2]], round(target[rows[i][2]], 6), taken[i]) for i in range(len(rows))), key=repr)


CASES = {
    "mixed": [(i, "w " * (i * 37 % 90), ["a", "b", "c", "d", None, "é", "Z"][i * i % 7]) for i in range(120)],
    "hot": [(i, "w " * 10, "a" if i % 10 else f"s{i}") for i in range(200)],
    "one": [(1, "a b c", "x")],
    "ties": [(7, "a b c", "x"), (7, "a b c", "x"), (None, "d e", "x"), (None, None, None), (3, "", "y"), (4, " ", "z")],
    "no words": [(1, None, "a"), (2, "", "b")],
    "long": [(i, "word " * (20_000 if i == 3 else 50), "ab"[i % 2]) for i in range(20)],
}


@pytest.mark.parametrize("name", CASES)
def test_agrees_with_brute_force(spark, name):
    rows = CASES[name]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows], "doc_id long, text string, source string, size int, key string")
    result = mixing.mix(docs).collect()
    assert sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in result), key=repr) == brute(rows)
    assert all(r.taken <= 2 * r.size for r in result)
    assert sorted(mixing.mix(docs).collect(), key=repr) == sorted(result, key=repr)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies = defaultdict(int)
    for r in result:
        copies[r.doc_id] += r.copies
    got = defaultdict(int)
    for r in mixed.collect():
        got[r.doc_id] += 1
    if len({r[0] for r in rows}) == len(rows):
        assert got == {d: n for d, n in copies.items() if n}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(docs).count() == 0
    assert mixing.mixed_documents(docs).count() == 0
