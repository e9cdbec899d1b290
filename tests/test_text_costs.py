"""Text rules search a text few times, and odd texts are read as before."""

import re

import pytest
from pyspark.sql import functions as F

from clausegrid.functions import fixed as K
from clausegrid.functions import text as T
from clausegrid.operators import assessment as A
from clausegrid.operators import extraction as X

BLANK = "[" + T.BLANKS + "]"
ODD = [
    "", " ", ". ", "a", "1. The agent shall file the report.  (b) It must answer the letter;  Then it may pay the due fee.;; ",
    "  The\u0085agent shallow shall not\nfile reports.　", "a. b. C. D shall go to the market;", "The x \U0001f600 shall reach the \U0001f600 yard.  1 y",
    "They STAND SUPERSEDED and shall file reports", "ſtand ſuperseded they shall file reports", "\x1cagent\x1c shall file the reports\x1c",
    "Pay within (15) working days. No fee ſhall apply", "t + 2 and shall  NOT pay", "12 34 ٥ DAYS", "# Head\nThe desk MAY pay 5%. It iſ allowed.", "may not pay; MAY not",
    "ıs allowed", "no one here ſhall", "x " * 300 + "shall pay the due fee within 3 days", "para. \n\n The next shall be written here.\n",
]


def plain_obligations(text):
    at, out = 0, []
    pieces, gaps = re.split(rf"(?<=[.;]){BLANK}+(?=[A-Z(\d])", text), re.findall(rf"(?<=[.;]){BLANK}+(?=[A-Z(\d])", text)
    for piece, gap in zip(pieces, [*gaps, ""]):
        marker = re.match(rf"{BLANK}*(?:\d+(?:\.\d+)*\.?|\([a-z0-9]{{1,4}}\)){BLANK}+", piece)
        size = marker.end() if marker else 0
        body = piece[size:].rstrip(T.BLANKS)
        hit = re.search(r"\b(shall|must|may|should)\b", body)
        if hit and not re.search(K.NO_REQUIREMENT, body.replace("ſ", "s")):
            actor = body[: hit.start()].strip(T.BLANKS)
            action = body[hit.end() :].strip(T.BLANKS).rstrip(".;").rstrip(T.BLANKS)
            if actor and len(re.split(f"{BLANK}+", actor)) <= 8 and len(action) >= 10:
                kept = body.rstrip(";")
                out.append((kept, actor, action, hit[0], at + size, at + size + len(kept)))
        at += len(piece) + len(gap)
    return out


def test_obligations_of_odd_texts(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "id int, text string")
    found = {}
    for r in X.extract_obligations(rows, ["id"]).collect():
        found.setdefault(r.id, []).append((r.text, r.actor, r.action, r.modality, r.char_start, r.char_end))
    assert found == {i: p for i, t in enumerate(ODD) if (p := plain_obligations(t))}


def test_sentences_and_blanks_are_as_before(spark):
    rows = spark.createDataFrame([(t,) for t in [*ODD, None]], "t string")
    plain = lambda pattern: F.regexp_replace("t", T.U + pattern, "")
    new = rows.select(T.sentences(F.col("t")), T.strip(F.col("t")), T.rstrip(F.col("t")), T.lstrip(F.col("t")))
    old = rows.select(T.split_with_offsets(F.col("t"), K.SENTENCE_BREAK), plain(r"^\s+|\s+$"), plain(r"\s+$"), plain(r"^\s+"))
    assert [tuple(r) for r in new.collect()] == [tuple(r) for r in old.collect()]


@pytest.mark.parametrize("rule, pattern", [(T.prohibits, K.PROHIBITION), (T.permits, K.PERMISSION)])
def test_flags_of_odd_texts(spark, rule, pattern):
    rows = spark.createDataFrame([(t,) for t in ODD], "t string")
    assert all(r[0] == r[1] for r in rows.select(rule(F.col("t")), T.found(F.col("t"), pattern)).collect())


def test_quantities_of_odd_texts(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "t string")
    got = rows.select(T.stated_quantity(F.col("t"))["matched"], T.blank_to_null(F.regexp_extract("t", T.U + K.QUANTITY, 0))).collect()
    assert all(r[0] == r[1] for r in got) and any(r[0] for r in got)


def searches(df, *functions):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(len(re.findall(rf"\b{name}\(", plan)) for name in functions)


def test_an_obligation_is_searched_few_times(spark):
    rows = spark.createDataFrame([(1, "The agent shall pay the due fee.")], "id int, text string").repartition(1)
    # A break, a marker, the modal word twice, a rule out, blanks of the actor and its words.
    assert searches(X.extract_obligations(rows, ["id"]), "regexp_extract", "regexp_extract_all", "regexp_replace", "regexp_substr", "rlike", "split", "RLIKE") <= 8


def test_the_sentence_of_a_limit_is_looked_for_once(spark):
    rows = spark.createDataFrame([("Pay the fee within 5 days.",)], "obligation_text string").repartition(1)
    plan = A.obligation_features(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(K.CLAUSE_SENTENCE) <= 2


def test_spans_of_extractions_meet_once(spark, monkeypatch):
    from clausegrid.operators import evaluation as E

    plans, cut = [], E.cut_lineage
    monkeypatch.setattr(E, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    rows = spark.createDataFrame([(1, 7, "the agents", 0, 20), (2, 7, "Agent", 10, 30), (3, 7, "", 0, 40), (4, 8, "agency", 0, 9)], "id long, circular_id long, actor string, char_start long, char_end long")
    found = E.match_extractions(rows, rows.withColumn("id", F.col("id") + 10))
    assert sorted((r.pred_id, r.label_id) for r in found.collect()) == [(1, 11), (2, 12), (4, 14)]
    assert sum("Generate" in plan for plan in plans) == 1


@pytest.mark.parametrize("supplier, actor", [(5, "Supplier 5"), (-5, "")])
def test_actors_of_obligations(spark, tmp_path, supplier, actor):
    from clausegrid.plans.corpora import Corpora

    given = spark.createDataFrame([(1, supplier, "N", "ring", 3.0, 1, 90)], "l_orderkey long, l_suppkey long, l_returnflag string, p_name string, l_quantity double, item_no long, char_end long")

    class Given(Corpora):
        items = property(lambda self: given)

    found = Given(spark, str(tmp_path)).obligations.first()
    assert (found.actor, found.text) == (actor, f"Supplier {supplier} may deliver the ring lot within 3 days of each request.")
    assert (found.char_start, found.char_end) == (90 - len(found.text), 90)
