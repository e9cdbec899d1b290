"""Literal cases for the text rules, fusion, agreement and budgets."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from clausegrid.functions import text as T
from clausegrid.operators import assessment as A
from clausegrid.operators import evaluation as E
from clausegrid.operators import extraction as X
from clausegrid.operators import references as R
from clausegrid.operators import retrieval as V
from clausegrid.operators import segmentation as G


def value(spark, column, **row):
    df = spark.createDataFrame([tuple(row.values())], list(row)) if row else spark.range(1)
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "raw, key",
    [
        ("SEBI/HO/CFD/PoD-2/P/CIR/2023/120", "SEBI/HO/CFD/POD/2/P/CIR/2023/120"),
        (" (cir-mrd-dp-54-2017). ", "CIR/MRD/DP/54/2017"),
        ("IMD//FII&C/2010/07/", "IMD/FII&C/2010/07"),
    ],
)
def test_normalised_references(spark, raw, key):
    assert value(spark, T.normalise_reference(F.col("t")), t=raw) == key


@pytest.mark.parametrize(
    "token, day",
    [
        ("October 06, 2023", datetime.date(2023, 10, 6)),
        ("6 october 2023", datetime.date(2023, 10, 6)),
        ("06.10.2023", datetime.date(2023, 10, 6)),
        ("6-1-2023", datetime.date(2023, 1, 6)),
        ("31/02/2023", None),
        ("soon", None),
    ],
)
def test_dates(spark, token, day):
    assert value(spark, T.parse_date_token(F.col("t")), t=token) == day


@pytest.mark.parametrize(
    "text, cue",
    [
        ("This circular shall supersede the earlier one, which stands modified", "supersedes"),
        ("stands rescinded from today", "rescinds"),
        ("is partially modified", "partial"),
        ("shall stand modified", "amends"),
        ("the format at Annexure 1 shall be used", None),
        ("circulars listed at Annexure - 1 are hence rescinded; those listed in Annexure 1 are rescinded", "supersedes"),
    ],
)
def test_cues(spark, text, cue):
    assert value(spark, T.supersession_cue(F.col("t")), t=text) == cue


@pytest.mark.parametrize(
    "text, unit, number",
    [
        ("settle by T+1 day", "T+ settlement days", 1),
        ("within five (5) years", "years", 5),
        ("15 calendar days", "days", 15),
        ("30%", "percent", 30),
        ("no limit", None, None),
    ],
)
def test_quantities(spark, text, unit, number):
    got = value(spark, T.stated_quantity(F.col("t")), t=text)
    assert (got.unit, got.value) == (unit, number)


def test_quotes_are_found_through_line_breaks_and_code_points(spark):
    got = value(spark, T.resolve_quote(F.col("q"), F.col("s")), q=" b  c ", s="\U0001f600 a b\nc d")
    assert (got.start, got.end) == (4, 7)
    assert value(spark, T.resolve_quote(F.col("q"), F.col("s")), q="(a.b)", s="x (a.b) y").start == 2
    assert value(spark, T.resolve_quote(F.col("q"), F.col("s")), q="missing", s="text") is None
    assert value(spark, T.resolve_quote(F.col("q"), F.col("s")), q="  ", s="text") is None


@pytest.mark.parametrize(
    "actor, norm",
    [("The Intermediaries", "intermediary"), ("every broker", "broker"), ("All boss", "boss"), ("ties", "tie"), (None, "")],
)
def test_actors(spark, actor, norm):
    df = spark.createDataFrame([(actor,)], "t string")
    assert df.select(T.normalise_actor(F.col("t")).alias("v")).first().v == norm


def test_obligations_and_their_spans(spark):
    text = "1. The stock broker shall report each breach within 6 hours; Records must be kept for five years. Circulars listed stand superseded and shall go."
    rows = X.extract_obligations(spark.createDataFrame([(1, text)], "id long, text string"), ["id"]).collect()
    assert [(r.actor, r.modality) for r in rows] == [("The stock broker", "shall"), ("Records", "must")]
    assert all(text[r.char_start : r.char_end] == r.text for r in rows)


def test_references_and_dates_carry_absolute_offsets(spark):
    text = "See SEBI/HO/CFD/PoD-2/P/CIR/2023/120 dated October 06, 2023 and CIR/MRD/DP/54/2017, not 2/3 in 2023."
    df = spark.createDataFrame([(1, text, 100)], "id long, text string, char_start long")
    refs = R.find_references(df, ["id"]).orderBy("char_start").collect()
    assert [r.raw_reference for r in refs] == ["SEBI/HO/CFD/PoD-2/P/CIR/2023/120", "CIR/MRD/DP/54/2017"]
    assert all(text[r.char_start - 100 : r.char_end - 100] == r.raw_reference for r in refs)
    assert R.dated_phrases(df, ["id"]).first().parsed == datetime.date(2023, 10, 6)


def test_segments_slice_the_full_text(spark):
    pages = [
        (1, 1, "PART A\r\n1. First rule.  \ncontinued\n\n| a | b |\n| c | d |\nafter"),
        (1, 2, "carried over\n2.1 Second ﬁle­ rule"),
    ]
    df = spark.createDataFrame(pages, "doc_id long, page_number int, text string")
    paragraphs = G.segment_corpus(df).orderBy("order_index").collect()
    full = G.assemble_full_text(G.segment_corpus(df)).first().full_text
    assert [p.text for p in paragraphs] == [
        "PART A",
        "1. First rule.\ncontinued",
        "| a | b |\n| c | d |",
        "after",
        "carried over",
        "2.1 Second file rule",
    ]
    assert [p.para_number for p in paragraphs] == [None, "1", None, None, None, "2.1"]
    assert {p.heading_path for p in paragraphs} == {"PART A"}
    assert all(full[p.char_start : p.char_end] == p.text for p in paragraphs)


def test_chunks_keep_overlap_and_close_on_oversized_paragraphs(spark):
    sizes = [200, 150, 40, 100, 450, 30]
    rows, at = [], 0
    for i, tokens in enumerate(sizes):
        rows.append((7, i, "x" * tokens * 4, at, at + tokens * 4, None))
        at += tokens * 4 + 2
    schema = "doc_id long, order_index int, text string, char_start long, char_end long, heading_path string"
    chunks = G.chunk_paragraphs(spark.createDataFrame(rows, schema)).orderBy("order_index").collect()
    assert [(c.first_paragraph, c.last_paragraph) for c in chunks] == [(0, 2), (2, 3), (4, 4), (5, 5)]


def test_fusion_adds_contributions_and_breaks_ties_by_id(spark):
    hits = [(1, "dense", 10, 1), (1, "dense", 11, 2), (1, "dense", 10, 5), (1, "lexical", 11, 1), (1, "lexical", 12, 1)]
    rows = V.rrf_fusion(spark.createDataFrame(hits, "query_id long, retriever string, chunk_id long, rank int")).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == [11, 10, 12]
    assert rows[0].rrf_score == pytest.approx(1 / 62 + 1 / 61)
    assert (rows[1].dense_rank, rows[1].lexical_rank) == (1, None)


def test_kappa_is_undefined_when_nothing_varies(spark):
    same = spark.createDataFrame([(True, True)] * 4, "judge_supported boolean, human_supported boolean")
    row = E.cohens_kappa(same).first()
    assert row.cohens_kappa is None and row.raw_agreement == 1.0 and row.interpretation.startswith("undefined")
    none = E.cohens_kappa(same.limit(0)).first()
    assert none.raw_agreement is None and none.kappa_undefined == "no pairs to compare"


@pytest.mark.parametrize(
    "obligation, clause, impact",
    [
        ("Brokers shall report cyber incidents to the authority within 6 hours.", "The desk shall report cyber incidents to the authority within 24 hours.", "MODIFIED"),
        ("Brokers shall not share client passwords with outside vendors.", "The desk may share client passwords with outside vendors.", "CONFLICT"),
        ("Brokers shall report cyber incidents to the authority.", "The desk shall report cyber incidents to the authority.", "ALREADY_COVERED"),
        ("Brokers shall report cyber incidents to the authority.", "Lunch is served at noon in the canteen.", "NO_MATCH"),
    ],
)
def test_verdicts(spark, obligation, clause, impact):
    df = spark.createDataFrame([(obligation, clause, "A.1")], "obligation_text string, clause_text string, clause_number string")
    assert A.judge_pairs(df).first().impact_type == impact


def test_the_call_that_crosses_the_token_limit_still_counts(spark):
    calls = spark.createDataFrame([("r", i, 40) for i in range(6)], "run_id string, seq long, tokens long")
    decided = A.apply_budget(calls, {"range": F.expr("seq div 2")}, ["seq"], 100, 100)
    assert [r.refused for r in decided.orderBy("seq").collect()] == [False, False, False, True, True, True]
    total = A.budget_totals(decided, 100, 100).first()
    assert (total.calls, total.tokens) == (3, 120)
    assert total.exhausted_reason == "Token budget reached: 120 of 100 tokens."


def test_constraints_of_states_and_sequences(spark):
    from clausegrid.operators.spans import check_constraints

    none = lambda schema: spark.createDataFrame([], schema)
    span = "id long, char_start long, char_end long"
    found = check_constraints(
        none("circular_number string"),
        none(f"{span}, text string, extraction_method string"),
        none(f"{span}, circular_id long, paragraph_id long, text string"),
        none(f"{span}, policy_pack_id long, clause_number string"),
        citations=spark.createDataFrame([(1, "regex"), (2, "guess"), (3, None)], "id long, resolution_method string"),
        supersessions=spark.createDataFrame([(1, "amends"), (2, "ends")], "id long, supersession_type string"),
        assessments=spark.createDataFrame([(1, "PENDING"), (2, "LOST")], "id long, status string"),
        steps=spark.createDataFrame([(1, 7, 1, "OK"), (2, 7, 1, "OK"), (3, 8, 1, "ODD")], "id long, run_id long, seq long, status string"),
    )
    assert sorted(map(tuple, found.collect())) == [
        ("assessment status is unknown", "2"),
        ("resolution method is unknown", "2"),
        ("resolution method is unknown", "3"),
        ("step sequence is not unique in its run", "7|1"),
        ("step status is unknown", "3"),
        ("supersession type is unknown", "2"),
    ]


def plain_quote(quote, source):
    """The published rule in plain Python: the stripped quote itself, else its words with any blanks between."""
    body = (quote or "").strip()
    if not body or not source:
        return None
    if body in source:
        return source.index(body), source.index(body) + len(body)
    hit = re.search(r"\s+".join(map(re.escape, body.split())), source)
    return None if hit is None else (source.index(hit.group()), source.index(hit.group()) + len(hit.group()))


def test_quotes_agree_with_the_plain_rule(spark):
    sources = ["a b\nc d", "a  b c d a b c", "\U0001f600 a\t\n b.", "x (a.b)  y\\E z", "ab c", " a b ", "", None, "b c a b\n\nc"]
    quotes = ["a b", "b c", " b  c\n", "a b", "c d", "a.b", "(a.b) y\\E z", "y \\E", "a b c", "", "  ", None, "d a", "\U0001f600 a b."]
    rows = spark.createDataFrame([(q, s) for q in quotes for s in sources], "q string, s string").select(
        "q", "s", T.resolve_quote(F.col("q"), F.col("s")).alias("v")
    )
    for q, s, v in rows.collect():
        assert (None if v is None else (v.start, v.end)) == plain_quote(q, s), (q, s)


def test_an_answer_is_read_once(spark):
    schema = "id long, answer string, source string, base_offset long, tokens_in int, tokens_out int, cost_usd double"
    item = '{"obligations": [{"text": "%s", "modality": "shall"}, {"text": "nowhere to be found"}]}'
    rows = [(1, item % "must  file it", "We must\\nfile it", 10, 1, 2, 0.5), (2, "no json", "x", 0, 1, 2, 0.5), (3, item % "short", "short", 0, 1, 2, None), (4, None, "x", 0, 1, 2, 0.5)]
    found, report = X.validate_extractions(spark.createDataFrame(rows, schema), ["id"])
    for df in (found, report):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [(r.id, r.char_start, r.char_end) for r in found.collect()] == []
    rows[0] = (1, item % "must  file it", "We must\nfile it", 10, 1, 2, 0.5)
    found, report = X.validate_extractions(spark.createDataFrame(rows, schema), ["id"])
    assert [(r.id, r.text, r.char_start, r.char_end) for r in found.collect()] == [(1, "must  file it", 13, 25)]
    assert report.first() == (4, 3, 1, 1, 4, 8, None)
