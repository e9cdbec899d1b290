"""Skewed keys against brute force, exact percentiles, greedy rules, plans and files."""

import random

import pytest
from pyspark.sql import functions as F

from clausegrid.functions.scan import hot_slots, running_last, running_previous, running_totals
from clausegrid.operators import assessment as A
from clausegrid.operators import evaluation as E
from clausegrid.plans.corpora import Corpora
from clausegrid.sources import ingest, jsonl, manifests


def skewed(n=600, seed=3):
    rng = random.Random(seed)
    return [(0 if rng.random() < 0.5 else rng.randrange(1, 9), i, rng.randrange(50), rng.choice([None, "a", "b"])) for i in range(n)]


def test_running_values_of_a_hot_key(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "k int, i int, v long, s string")
    cut = {"range": F.expr("i div 37")}
    got = running_totals(df, ["k"], cut, ["i"], {"through": F.col("v")})
    got = running_last(got, ["k"], cut, ["i"], F.col("s"), "last")
    got = running_previous(got, ["k"], cut, ["i"], F.col("s"), "before")
    seen, want = {}, {}
    for k, i, v, s in rows:
        total, last, before = seen.get(k, (0, None, None))
        seen[k] = (total + v, s or last, s)
        want[i] = (total + v, s or last, before)
    assert {r.i: (r.through, r["last"], r.before) for r in got.collect()} == want


def test_exact_percentiles(spark):
    rng = random.Random(1)
    rows = [(k, rng.uniform(-50, 900)) for k in (1, 1, 1, 2) for _ in range(101)]
    df = spark.createDataFrame(rows, "k int, v double")
    got = E.exact_percentiles(df, ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()
    want = df.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("p50"), F.percentile("v", F.lit(0.95)).alias("p95")).collect()
    by = {r.k: r for r in want}
    for r in got:
        assert (r.p50, r.p95) == pytest.approx((by[r.k].p50, by[r.k].p95))


def test_matching_takes_turns(spark):
    rng = random.Random(5)
    spans = lambda n: [(i, 1, "broker", s := rng.randrange(4000), s + rng.randrange(5, 300)) for i in range(n)]
    predicted, labelled = spans(120), spans(90)
    key = lambda r: (r[3], r[4], r[0])
    free, want = sorted(labelled, key=key), set()
    for p in sorted(predicted, key=key):
        for g in free:
            if p[3] < g[4] and g[3] < p[4]:
                want.add((p[0], g[0]))
                free.remove(g)
                break
    schema = "id long, circular_id long, actor string, char_start long, char_end long"
    got = E.match_extractions(spark.createDataFrame(predicted, schema), spark.createDataFrame(labelled, schema))
    assert {tuple(r) for r in got.collect()} == want


def test_ingestion_goes_row_by_row(spark):
    rng = random.Random(9)
    batch = [(i, f"s{rng.randrange(25)}", f"n{rng.randrange(25)}", rng.random() < 0.9) for i in range(120)]
    stored = [("s1", "n1"), ("s2", "n2")]
    sums, numbers, want = {s for s, _ in stored}, {n for _, n in stored}, {}
    for i, s, n, text in batch:
        want[i] = "skipped" if s in sums else "conflict" if n in numbers else "ingested" if text else "failed"
        if want[i] == "ingested":
            sums.add(s), numbers.add(n)
    got = ingest.classify_ingest(
        spark.createDataFrame(batch, "batch_order long, checksum string, circular_number string, has_text boolean"),
        spark.createDataFrame(stored, "checksum string, circular_number string"),
    )
    assert {r.batch_order: r.outcome for r in got.collect()} == want


def test_candidates_equal_scoring_every_pair(spark):
    rng = random.Random(2)
    words = "alpha bravo cargo delta eagle fjord grain hotel igloo joker".split()
    text = lambda: " ".join(rng.sample(words, rng.randrange(1, 7)))
    tasks = [(1, i, rng.randrange(3), text()) for i in range(60)] + [(1, 99, 0, "")]
    clauses = [(i, rng.randrange(2), f"A.{i}", text()) for i in range(40)]
    found, lonely = A.rank_clauses(
        spark.createDataFrame(tasks, "assessment_id long, obligation_id long, policy_pack_id long, text string"),
        spark.createDataFrame(clauses, "id long, policy_pack_id long, clause_number string, text string"),
        threshold=0.6,
    )
    want, closest = set(), {}
    for _, o, pack, t in tasks:
        terms = set(t.split())
        ranked = sorted((-(len(terms & set(c[3].split())) / len(terms) if terms else 0.0), c[0]) for c in clauses if c[1] == pack)
        good = [c for s, c in ranked if -s >= 0.6][:3]
        want |= {(o, c) for c in good}
        if not good:
            closest[o] = ranked[0][1] if ranked else None
    assert {(r.obligation_id, r.clause_id) for r in found.collect()} == want
    assert {r.obligation_id: r.closest_id for r in lonely.collect()} == closest


def test_topn_is_limited_before_the_exchange(spark):
    from clausegrid.functions.ranking import top_n

    plan = top_n(spark.range(1000).withColumn("k", F.col("id") % 3), ["k"], [F.col("id").desc()], 5)
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_manifest_round_trip_and_bad_lines(spark, tmp_path):
    row = ("N/1", "T", None, "CFD", "circular", "u", "f.pdf", None, None, "abc", None)
    entries = spark.createDataFrame([row], manifests.MANIFEST)
    manifests.manifest_sink(entries, f"{tmp_path}/m")
    line = spark.read.text(f"{tmp_path}/m").first().value
    assert '"issue_date":null' in line and "page_url" not in line and '"sha256":"abc"' in line
    assert manifests.manifest_scan(spark, f"{tmp_path}/m").first().parsed_date is None
    (tmp_path / "x.jsonl").write_text('{"circular_number": "a"}\n\nnot json\n[1]\n{"circular_number": \n')
    good, bad = jsonl.jsonl_with_errors(jsonl.numbered_lines(spark, f"{tmp_path}/x.jsonl"), manifests.MANIFEST)
    assert [(r.line_no, r.circular_number) for r in good.collect()] == [(1, "a")]
    assert sorted((r.line_no, r.problem) for r in bad.collect()) == [(3, "not JSON"), (4, "not a JSON object"), (5, "not JSON")]


def test_replacing_a_key_twice_leaves_one_copy(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "label string, v int")
    for _ in range(2):
        jsonl.replace_by_key(df, f"{tmp_path}/r", "label")
    jsonl.replace_by_key(df.where("label = 'b'").withColumn("v", F.lit(3)), f"{tmp_path}/r", "label")
    assert sorted((r.label, r.v) for r in spark.read.parquet(f"{tmp_path}/r").collect()) == [("a", 1), ("b", 3)]


def test_files_are_hashed(spark, tmp_path):
    (tmp_path / "a_1.pdf").write_bytes(b"one")
    (tmp_path / "b.txt").write_bytes(b"two")
    files = manifests.document_scan(spark, str(tmp_path)).collect()
    assert [(f.filename, f.bytes) for f in files] == [("a_1.pdf", 3)]


def test_stream_ingest_decides_against_what_is_stored(spark, tmp_path):
    from clausegrid.streaming.ingest import stream_ingest

    schema = "batch_order long, checksum string, circular_number string, has_text boolean"
    spark.createDataFrame([(1, "s1", "n1", True), (2, "s1", "n2", True)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")

    def run():
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        stream_ingest(source, f"{tmp_path}/store", f"{tmp_path}/out", f"{tmp_path}/ckpt").awaitTermination()
        return {r.batch_order: r.outcome for r in spark.read.parquet(f"{tmp_path}/out").collect()}

    assert run() == {1: "ingested", 2: "skipped"}
    spark.createDataFrame([(3, "s3", "n1", True), (4, "s4", "n4", True)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == {1: "ingested", 2: "skipped", 3: "conflict", 4: "ingested"}


@pytest.mark.parametrize("rows", [0, 100, 10**6])
def test_running_totals_that_cut_hot_slots_only(spark, rows):
    data = skewed()
    df = spark.createDataFrame(data, "k int, i int, v long, s string")
    hot = hot_slots(df, ["k"], rows)
    assert bool(hot) == (rows < 10**6)
    got = running_totals(df, ["k"], {"range": F.expr("i div 37")}, ["i"], {"through": F.col("v")}, hot)
    seen, want = {}, {}
    for k, i, v, _ in data:
        seen[k] = want[i] = seen.get(k, 0) + v
    assert {r.i: r.through for r in got.collect()} == want


def test_lines_of_an_order_are_shuffled_by_the_order_once(spark):
    c = Corpora(spark, "/root/testdata/sf0.001")
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (c.paragraphs, c.obligations, c.findings)]
    assert not any("Join" in plan or "Window" in plan or "Aggregate" in plan for plan in plans)


def test_offsets_of_a_circular_whose_lines_are_cut_into_ranges(spark, monkeypatch):
    from clausegrid.plans import corpora

    plain = {tuple(r) for r in Corpora(spark, "/root/testdata/sf0.001").paragraphs.collect()}
    monkeypatch.setattr(corpora, "_WRITTEN", {})
    monkeypatch.setattr(corpora, "hot_slots", lambda df, keys: list(range(0, 4096, 2)))
    assert {tuple(r) for r in Corpora(spark, "/root/testdata/sf0.001").paragraphs.collect()} == plain


def test_pairs_of_few_distinct_texts_are_not_shuffled(spark):
    tasks = [(i, i, 1, f"Agent {i} shall deliver the green widget within {i % 9} days.", 5 * i) for i in range(300)]
    tasks = spark.createDataFrame(tasks, "assessment_id long, obligation_id long, policy_pack_id long, text string, char_start long")
    body = "### A.%d Delivery of green widget\n\nThe desk shall keep green widget stock for %d days."
    clauses = [(i, 1, f"A.{i}", body % (i, i), 100 * i) for i in range(40)]
    clauses = spark.createDataFrame(clauses, "id long, policy_pack_id long, clause_number string, text string, char_start long")
    pairs, unmatched = A.candidate_pairs(tasks, clauses)
    plan = A.judge_pairs(pairs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    whole = [r.asDict() for r in A.judge_pairs(pairs).select("assessment_id", "policy_clause_id", "impact_type").collect()]
    assert len(whole) == 900 and {r["policy_clause_id"] for r in whole} == {0, 1, 2} and unmatched.count() == 0


def test_empty_and_missing_texts_are_scanned_too(spark, tmp_path):
    from checking import differences

    import __spark_entry__ as entry

    rows = [(1, ""), (2, None), (3, "plain"), (4, "aé\U0001f600"), (None, "unnamed"), (5, "")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = "SELECT 'doc_' || doc_id || '.pdf' AS filename, strlen(text) AS bytes, sha256(text) AS checksum FROM documents"
    assert differences(entry.queries()["document_scan"](spark, str(tmp_path)), con, sql) is None


def test_files_in_folders_are_scanned_and_hidden_ones_are_not(spark, tmp_path):
    import hashlib

    manifests.write_files(spark.createDataFrame([("x/a.pdf", b"one"), ("y/b.pdf", b""), ("c.pdf", b"x" * (3 << 20)), ("x/d.txt", b"no")], "filename string, content binary"), str(tmp_path))
    (tmp_path / "x" / ".e.pdf").write_bytes(b"part")
    found = {(r.filename, r.bytes, r.checksum) for r in manifests.document_scan(spark, str(tmp_path)).collect()}
    want = {"a.pdf": b"one", "b.pdf": b"", "c.pdf": b"x" * (3 << 20)}
    assert found == {(k, len(v), hashlib.sha256(v).hexdigest()) for k, v in want.items()}


def test_highlighting_sends_no_places_of_texts_to_the_driver(spark):
    from clausegrid.operators.spans import highlight_segments

    texts = spark.createDataFrame([(1, "abcdefghij", 100), (2, "klm", 0), (3, "", 7)], "parent_id long, text string, text_start long")
    marks = [(1, "a", 102, 104), (1, "b", 102, 109), (1, "c", 103, 105), (1, "d", 99, 101), (1, "e", 104, 111), (2, "f", 0, 3), (2, "g", 2, 2), (3, "h", 7, 8), (1, "i", 109, 110)]
    spans = spark.createDataFrame(marks, "parent_id long, span_id string, start long, end long")
    segments, outside = highlight_segments(texts, spans)
    for part in (segments, outside):
        assert "Broadcast" not in part._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.parent_id, r.segment, r.text, r.span_id) for r in segments.collect()) == [
        (1, 0, "ab", None), (1, 1, "cd", "a"), (1, 2, "efghi", None), (1, 3, "j", "i"), (2, 0, "klm", "f")]
    assert sorted(r.span_id for r in outside.collect()) == ["d", "e", "g", "h"]


def test_the_export_is_made_once_for_its_report(spark):
    import __spark_entry__ as entry

    report = entry.queries()["upsert_report"](spark, "/root/testdata/sf0.001")
    assert report._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert "obligation" not in report._jdf.queryExecution().optimizedPlan().toString()


def test_an_export_without_obligations_is_the_same(spark):
    from clausegrid.operators import ledger as L
    from clausegrid.plans.corpora import Corpora

    c = Corpora(spark, "/root/testdata/sf0.001")
    runs = c.assessments.select(F.col("id").alias("assessment_id"), F.lit("remote").alias("provider"), F.lit("m").alias("model"), F.lit("g").alias("graph_version"))
    texts = c.obligations.select(F.col("id").alias("obligation_id"), F.col("text").alias("obligation_text"), F.col("char_start").alias("obligation_start"))
    export = lambda findings, obligations: {tuple(r) for r in L.snapshot_export(findings, c.assessments, c.circulars, obligations, c.packs, c.clauses, runs).collect()}
    carried = export(c.findings.join(texts, "obligation_id"), None)
    assert carried == export(c.findings, c.obligations) and len(carried) > 100
