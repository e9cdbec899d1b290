"""Personal data against a brute-force version, hand-written texts, and odd tables."""

import hashlib
import random
import re
import time

import pytest

from clausegrid.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def confirmed(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        found += [(m.start(), order, m.end(), kind) for m in re.finditer(pattern, text or "") if confirmed(kind, m.group())]
    return sorted(found)


def digest(found):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in found).encode()).hexdigest()


def random_texts():
    rng = random.Random(7)
    bits = ["a@b.c", "%", "x.y@d-e.f.g", "@", ".", "+", "-", " ", "4929 1234 5678 9017", "4111111111111111", "+1 (617) 555-0100", "1.2.3.4", "256.1.1.1",
            "10.0.0.255.7", "0001.2.3.4", "é", "😀", "12", "(", ")", "word", "\n", "+49 30 1234567", "a.b@c", "00000000000000", "5-5 5"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(800)] + [None, "", "4111 1111 1111 1111", "x" * 50]


def test_base_kinds_against_brute_force(spark):
    texts = random_texts()
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, spans int, kind string")
    for r in pii.personal_data_digest(df).collect():
        want = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w[3] == k for w in want) for k in BASE), texts[r.doc_id]
        assert r.base_sha256 == digest(want), texts[r.doc_id]


CASES = [
    ("My IBAN is DE89 3704 0044 0532 0130 00.", ["iban"]),
    ("Account GB29NWBK60161331926819, thanks", ["iban"]),
    ("GB28NWBK60161331926819 fails its check", []),
    ("Her social security number is 536-22-8726.", ["ssn"]),
    ("Order 536-22-8726 was shipped.", []),
    ("social security 000-22-8726", []),
    ("Phone: (617) 555-0123", ["local_phone"]),
    ("Call me at 617-555-0123 or 617-555-0199", ["local_phone", "local_phone"]),
    ("Build 617-555-0123 of the part", []),
    ("She was born on 12/04/1981 in Rome", ["birth_date"]),
    ("The meeting on 12/04/1981 was long", []),
    ("passport no. X1234567", ["passport"]),
    ("part X1234567", []),
    ("Call +1 (617) 555-0100 now", ["phone"]),
]


def test_checks_and_context(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string")
    for r in pii.find_personal_data(df).collect():
        assert [s.kind for s in r.spans] == CASES[r.doc_id][1], CASES[r.doc_id][0]
        assert all(CASES[r.doc_id][0][s.start : s.end] == s.value for s in r.spans)


def test_score_moves_with_context(spark):
    df = spark.createDataFrame([(1, "credit card 4111111111111111"), (2, "blue 4111111111111111"), (3, "order 4111111111111111")], "doc_id long, text string")
    score = {r.doc_id: r.spans[0].score for r in pii.find_personal_data(df).collect()}
    assert score[1] > score[2] > score[3]


def test_odd_tables(spark):
    schema = "doc_id long, text string"
    assert pii.personal_data_digest(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, "a@b.co"), (None, "a@b.co"), (3, None), (3, "")], schema)
    rows = pii.personal_data_digest(df).collect()
    assert sorted(r.n_email for r in rows) == [0, 0, 1, 1] and len(rows) == 4


@pytest.mark.parametrize("text", ["a" * 400_000, "1" * 400_000, "a.b@c" + ".d" * 150_000, "x@y.zz " * 60_000, "+1" + " " * 300_000, "1.2.3." * 60_000])
def test_very_long_texts(spark, text):
    start = time.time()
    r = pii.personal_data_digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert time.time() - start < 60
    assert r.base_sha256 == digest(brute(text) if "a" * 99 not in text and "1" * 99 not in text else [])


def test_native_plan(spark):
    plan = pii.personal_data_digest(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
