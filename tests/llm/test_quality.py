"""Quality rules against a brute-force version of the statistics and of the estimate."""

import math
import random
import re
from collections import Counter

import numpy as np

from clausegrid.llm import quality as q

WORD = re.compile("[^\x20\x09-\x0d]+")


def statistics(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {k for k, n in Counter(windows).items() if n > 1}
    marked = {i + k for i, x in enumerate(windows) if x in twice for k in range(3)}
    return dict(
        n_words=len(w), word_chars=sum(map(len, w)), n_symbols=sum(c in "#*$%&|<>" for c in text),
        n_lines=len(lines), n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(marked),
    )


def vector(s):
    n, chars = max(s["n_words"], 1), max(s["word_chars"], 1)
    if not s["word_chars"]:
        chars = 1
    raw = [math.log(chars / n), math.log1p(1000 * s["n_symbols"] / chars), s["n_dup_lines"] / max(s["n_lines"], 1), s["n_repeat_words"] / n]
    return [math.floor(x * q.UNIT + 0.5) for x in raw]


def limit(share, degrees):
    low, high = 0.0, 500.0
    for _ in range(100):
        mid = (low + high) / 2
        tail = math.exp(-mid / 2) * sum((mid / 2) ** k / math.factorial(k) for k in range(degrees // 2))
        low, high = (mid, high) if tail > share else (low, mid)
    return high


def estimate(x):
    """Mean and floored covariance of the concentrated rows, from the medians on."""
    floors = np.diag([(f * q.UNIT) ** 2 for f in q.FLOORS.values()])
    inner = limit(1 - q.COVERED, 4)
    factor = q.COVERED / (1 - math.exp(-inner / 2) * sum((inner / 2) ** k / math.factorial(k) for k in range(3)))
    mean, inverse = np.median(x, axis=0), np.linalg.inv(floors)
    before = None
    for _ in range(q.MAX_STEPS):
        d2 = np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)
        bins = np.floor(64 * np.log2(1 + 1024 * np.maximum(d2, 0)))
        cut = np.sort(bins)[math.ceil(q.COVERED * len(x)) - 1]
        inside = x[bins <= cut]
        mean = inside.mean(axis=0)
        inverse = np.linalg.inv(factor * np.cov(inside.T, bias=True) + floors)
        state = (len(inside), *inside.sum(axis=0))
        if state == before:
            break
        before = state
    return mean, inverse


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    rows = []
    for i in range(420):
        lang, source = rng.choice([("en", "a"), ("en", "a"), ("en", "b"), ("de", "a"), (None, None), ("fr", f"s{i % 9}")])
        kind, n = rng.random(), rng.choice([10, 49, 50, 60, 200, 400])
        if kind < 0.1:
            text = " ".join(word() + "%%%" for _ in range(n))
        elif kind < 0.2:
            text = " ".join([word() for _ in range(20)] * (n // 20 + 1))
        elif kind < 0.3:
            line = " ".join(word() for _ in range(12))
            text = "\n".join([line] * 2 + [" ".join(word() for _ in range(n))])
        else:
            text = " ".join(word() + rng.choice(["", "", ".\n", "é", "\t", "  "]) for _ in range(n))
        rows.append((i, text, lang, source))
    rows += [(1000, None, "en", "a"), (1001, "", "en", "a"), (None, rows[0][1], "en", "a"), (5, rows[5][1], rows[5][2], rows[5][3]), (1002, "a b a b a b a", "xx", "y")]
    rows.append((1003, "long " * 30_000, "en", "a"))
    rows.append((1004, " ".join(word() for _ in range(30_000)), "en", "a"))
    return rows


def test_agrees_with_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 7, 1.0) for r in rows], "doc_id long, text string, lang string, source string, n_words int, distance2 double")
    stats = [statistics(r[1]) for r in rows]
    failed = [s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"] for s in stats]
    usable = Counter((r[2], r[3]) for r, f in zip(rows, failed) if not f)
    group = [(r[2], r[3]) if usable[r[2], r[3]] >= q.MIN_GROUP else (r[2], "*rest") for r in rows]
    vectors = np.array([vector(s) for s in stats], float)
    kept, cut = [], limit(q.REJECT, 4)
    estimates = {}
    for g in set(group):
        inside = vectors[[i for i in range(len(rows)) if group[i] == g and not failed[i]]]
        estimates[g] = estimate(inside) if len(inside) >= q.MIN_GROUP else None
    for i in range(len(rows)):
        e = estimates[group[i]]
        far = e is not None and (vectors[i] - e[0]) @ e[1] @ (vectors[i] - e[0]) > cut
        kept.append(not failed[i] and not far)
    key = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = sorted(((r[0], *(s[k] for k in key), f, k2) for r, s, f, k2 in zip(rows, stats, failed, kept)), key=repr)
    got = sorted(((r.doc_id, *(r[k] for k in key), r.base_failed, r.kept) for r in q.assess_quality(docs).collect()), key=repr)
    assert got == want
    assert 0 < sum(kept) < len(kept) - sum(failed)
    good = q.good_documents(docs)
    assert good.columns == docs.columns
    assert sorted((r.doc_id for r in good.collect()), key=repr) == sorted((r[0] for r, k in zip(rows, kept) if k), key=repr)
    assert q.assess_quality(docs.limit(0)).count() == 0
    assert q.good_documents(docs.limit(0)).count() == 0


def test_plan_is_native(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = q.assess_quality(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
