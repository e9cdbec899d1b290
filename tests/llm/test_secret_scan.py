"""Secret scans: candidates by hand, the forest on held-out findings, and redaction."""

import random

import pytest
from pyspark.sql import functions as F

from clausegrid.llm import secret_scan as ss


def make(seed, n=300):
    rng = random.Random(seed)
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    rows, truth = [], {}
    for i in range(n):
        words = [rng.choice(["lorem", "ipsum", "dolor", "internationalisation_of", "sit."]) for _ in range(30)]
        kind = rng.choice("sscvn")
        if kind == "s":
            secret = hexes(40)
            words[10:10] = ["token", "=", f'"{secret}"']
            truth[i] = secret
        elif kind == "c":
            words[10:10] = ["card", "".join(rng.choice("0123456789") for _ in range(16))]
        elif kind == "v":
            words[10:10] = ["commit", hexes(40)]
        rows.append((i, " ".join(words), rng.choice(["src/a", None, "b"]), len(words)))
    return rows, truth


@pytest.fixture(scope="module")
def docs(spark):
    rows, truth = make(1)
    rows += [(1000, None, "x", 0), (1001, "", "x", 0), (None, "secret: pass12345word! x", None, 3), (1003, "z" * 300_000, "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int"), truth


def test_finds_the_secrets_and_leaves_the_rest(docs):
    frame, truth = docs
    found = ss.scan(frame).collect()
    assert {r.doc_id: r.secret for r in found if r.is_secret and r.doc_id is not None} == truth
    assert [r.secret for r in found if r.doc_id is None] == ["pass12345word!"]
    assert not [r for r in found if r.doc_id in (1000, 1001, 1003)]


def test_held_out_findings(spark):
    label = lambda rows, truth: ss.find_candidates(spark.createDataFrame(rows, "doc_id long, text string, source string, n int")).withColumn(
        "is_secret", F.col("doc_id").isin(list(truth)).cast("int"))
    train, test = (label(*make(seed)) for seed in (2, 3))
    score = ss.fit_forest(train)
    judged = test.select((score(F.col) >= ss.LIMIT).cast("int").alias("got"), "is_secret").collect()
    assert len(judged) > 150
    assert sum(r.got == r.is_secret for r in judged) / len(judged) > 0.97


def test_column_trees_score_as_the_model(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows, truth = make(4)
    found = ss.find_candidates(spark.createDataFrame(rows, "doc_id long, text string, source string, n int"))
    label = F.when(F.col("doc_id") % 7 == 0, 0.0).otherwise(F.col("doc_id").isin(list(truth)).cast("double"))
    noisy = found.withColumn("label", label)
    data = VectorAssembler(inputCols=list(ss.FEATURES), outputCol="features").transform(noisy)
    model = RandomForestClassifier(numTrees=5, maxDepth=4, seed=1).fit(data)
    both = model.transform(data).select("probability", ss._score(model, F.col).alias("score")).collect()
    assert all(abs(r.probability[1] - r.score) < 1e-9 for r in both)


def test_redaction(docs):
    frame, truth = docs
    out = ss.redacted(frame)
    assert out.schema.names == frame.schema.names
    before, after = ({r.doc_id: r for r in x.collect()} for x in (frame, out))
    for i, row in before.items():
        if i in truth:
            assert after[i].text == row.text.replace(truth[i], "[SECRET]") and after[i].n_chars == len(after[i].text)
        elif i is not None:
            assert after[i] == row
    assert after[None].text in ("secret: [SECRET] x", "secret: pass12345word! x")


def test_without_labels_every_candidate_counts(spark):
    frame = spark.createDataFrame([(1, "key = abc12345 and", None), (1, "key = abc12345 and", None)], "doc_id long, text string, source string")
    assert [(r.secret, r.score, r.is_secret) for r in ss.scan(frame).collect()] == [("abc12345", 1.0, True)] * 2
    assert ss.scan(frame.limit(0)).count() == 0
    assert ss.redacted(frame.limit(0)).count() == 0


def test_values_without_blanks_are_candidates(spark):
    texts = {
        1: ("x pwd=s3cr3tpw9 y", ["s3cr3tpw9"]), 2: ('password="Tr0ub4dor&3"', ["Tr0ub4dor&3"]), 3: ("api_key:Ab3dEf9h", ["Ab3dEf9h"]),
        4: (":secret=>'pa$$w.rd&x!y1'", ["pa$$w.rd&x!y1"]), 5: ("password = correct-horse-battery", ["correct-horse-battery"]),
        6: ('"auth_token":"QwErTyUiOp"', ["QwErTyUiOp"]), 7: ("color=darkgreen and note: something", []), 8: ("see https://example.com/about it", []),
        9: ("token=" + "a1" * 20, ["a1" * 20]), 10: ("ends in token = " + "b2" * 20 + ".", ["b2" * 20]), 11: ("passwd=abcdefgh12345678$9", ["abcdefgh12345678$9"]),
    }
    rows = [(k, v[0], "src/a") for k, v in texts.items()]
    found = {}
    for r in ss.find_candidates(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        found.setdefault(r.doc_id, []).append(r.secret)
        assert r.assigned == 1 and r.key_word == 1
    assert found == {k: v[1] for k, v in texts.items() if v[1]}
