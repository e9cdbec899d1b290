"""Running sums, offsets and chunks inside a row: against plain Python, on short rows and very long ones."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from clausegrid.functions import text as T
from clausegrid.operators import segmentation
from clausegrid.sources import manifests


@pytest.mark.parametrize("block,levels", [(256, 2), (3, 1), (3, 2)])
def test_running_sums(spark, block, levels):
    rng = random.Random(1)
    rows = [(i, [rng.randrange(-5, 50) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 3, 4, 9, 10, 27, 28, 255, 256, 257, 700, 5000])] + [(99, None)]
    df = spark.createDataFrame(rows, "i int, v array<int>")
    for r in df.select("v", T.running_sums(F.col("v"), block, levels).alias("s")).collect():
        total, want = 0, []
        for v in r.v or []:
            total += v
            want.append(total)
        assert r.s == (None if r.v is None else want)


def test_count_below(spark):
    rows = [([1, 3, 3, 7], k) for k in (0, 1, 2, 3, 4, 8)] + [([], 5)]
    df = spark.createDataFrame(rows, "v array<int>, k int")
    assert [r.n for r in df.select(T.count_below(F.col("v"), F.col("k")).alias("n")).collect()] == [0, 0, 1, 1, 3, 4, 0]


def test_offsets_of_a_very_long_text(spark):
    text = "Ünder rule 7, é shall act. " * 200_000
    df = spark.createDataFrame([(text,)], "text string")
    start = time.time()
    found = df.select(F.inline(T.matches_with_offsets(F.col("text"), r"\d|shall")))
    got = found.agg(F.count("*").alias("n"), F.sum("start").alias("total"), F.max("start").alias("last")).first()
    assert time.time() - start < 90
    want = [m.start() for m in re.finditer(r"\d|shall", text)]
    assert tuple(got) == (len(want), sum(want), want[-1])


def greedy(tokens, target, overlap):
    """Paragraph after paragraph, as one would do it by hand."""
    out, group = [], []
    for i, cost in enumerate(tokens):
        if group and sum(tokens[k] for k in group) + cost > target:
            out.append((group[0], group[-1]))
            kept = []
            for k in reversed(group):
                if sum(tokens[j] for j in kept) + tokens[k] > overlap:
                    break
                kept.insert(0, k)
            group = kept
        group = [*group, i]
        if cost >= target:
            out.append((group[0], group[-1]))
            group = []
    return out + ([(group[0], group[-1])] if group else [])


def test_chunks_against_plain_greed(spark):
    rng = random.Random(6)
    docs = [[rng.choice([1, 2, 3, 5, 8, 13, 19, 20, 21, 60]) for _ in range(rng.randrange(0, 60))] for _ in range(120)] + [[1] * 3000]
    rows = [(d, i, "word" * t, 10 * i, 10 * i + 5, f"h{i}") for d, tokens in enumerate(docs) for i, t in enumerate(tokens)]
    df = spark.createDataFrame(rows, "doc_id long, order_index int, text string, char_start int, char_end int, heading_path string").repartition(5)
    for target, overlap in ((20, 6), (20, 0), (20, 19), (1000, 3)):
        got = {}
        for r in segmentation.chunk_paragraphs(df, target, overlap).orderBy("doc_id", "order_index").collect():
            got.setdefault(r.doc_id, []).append((r.first_paragraph, r.last_paragraph))
            assert r.char_start == 10 * r.first_paragraph and r.char_end == 10 * r.last_paragraph + 5 and r.heading_path == f"h{r.first_paragraph}"
        assert got == {d: greedy(t, target, overlap) for d, t in enumerate(docs) if t}
    plan = segmentation.chunk_paragraphs(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapIn" not in plan


def test_lines_fail_alone(spark):
    lines = ['{"n": "5", "day": "2024-02-29"}', '{"n": "5", "day": "2023-02-29"}', '{"n": "five", "day": "2024-01-01"}', '{"n": "5"}', "{oops", "[1]", "", None, '{"day": "2024-01-01"}']
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(lines)], "line int, value string, n string")
    got = {r.line: r.reason for r in manifests.parse_isolated(df, {"n": "int", "day": "date"}, ("day",)).collect()}
    assert got == {0: None, 1: "day is no date", 2: "n is no int", 3: "no day", 4: "not JSON", 5: "not JSON", 6: "not JSON", 7: "not JSON", 8: None}
