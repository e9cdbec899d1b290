"""Views of assessments, findings, runs and steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions import fixed as K
from clausegrid.functions import text as T
from clausegrid.functions.ranking import first_per_key
from clausegrid.functions.scan import left_join_spread, running_count

PLACE_WIDTH = 1024  # characters per range when spans meet paragraphs


def findings_with_context(findings: DataFrame, obligations: DataFrame, clauses: DataFrame) -> DataFrame:
    """Findings with their obligation and, where there is one, their clause.

    Reading order is (assessment_id, obligation_start, clause_order nulls last, id).
    """
    o = obligations.select(
        F.col("id").alias("obligation_id"),
        F.col("text").alias("obligation_text"),
        F.col("char_start").alias("obligation_start"),
    )
    c = clauses.select(
        F.col("id").alias("policy_clause_id"), "clause_number", F.col("order_index").alias("clause_order")
    )
    return left_join_spread(findings.join(o, "obligation_id"), c, "policy_clause_id")


def finding_counts(findings: DataFrame) -> DataFrame:
    """Per assessment: total, distinct obligations, and counts by quote status, impact and decision."""

    def counts(column: str, values: tuple[str, ...]) -> list[Column]:
        return [F.count_if(F.col(column) == v).alias(v.lower()) for v in values]

    return findings.groupBy("assessment_id").agg(
        F.count("*").alias("total"),
        F.countDistinct("obligation_id").alias("assessed_obligations"),
        *counts("quote_status", K.QUOTE_STATUSES),
        *counts("impact_type", K.IMPACTS),
        *counts("analyst_decision", K.DECISIONS),
    )


def latest_run(runs: DataFrame) -> DataFrame:
    """Newest run per assessment, by start and then id."""
    return first_per_key(runs, ["assessment_id"], [F.col("started_at").desc(), F.col("id").desc()])


def assessment_summary(
    assessments: DataFrame,
    circulars: DataFrame,
    packs: DataFrame,
    runs: DataFrame,
    findings: DataFrame,
    obligations: DataFrame,
) -> DataFrame:
    c = circulars.select(F.col("id").alias("circular_id"), "circular_number", "title")
    p = packs.select(F.col("id").alias("policy_pack_id"), F.col("name").alias("pack_name"), "version")
    r = latest_run(runs).select(
        F.col("assessment_id").alias("id"), F.col("id").alias("agent_run_id"), "provider", "model"
    )
    n = finding_counts(findings).select(
        F.col("assessment_id").alias("id"), "total", "assessed_obligations", "verified", "failed"
    )
    o = obligations.groupBy("circular_id").agg(F.count("*").alias("obligations"))
    joined = (
        assessments.join(c, "circular_id")
        .join(p, "policy_pack_id")
        .join(r, "id", "left")
        .join(n, "id", "left")
        .join(o, "circular_id", "left")
    )
    zeros = ["total", "assessed_obligations", "verified", "failed", "obligations"]
    return joined.withColumns({z: F.coalesce(z, F.lit(0)) for z in zeros})


def price_table(spark) -> DataFrame:
    """The published list prices: model, US dollars per million tokens in and out."""
    return spark.createDataFrame(list(K.LIST_PRICES), "model string, price_in double, price_out double")


def estimate_cost(steps: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds cost_usd; null for a model without a price."""
    cost = F.col("tokens_in") / 1e6 * F.col("price_in") + F.col("tokens_out") / 1e6 * F.col("price_out")
    return steps.join(prices, "model", "left").withColumn("cost_usd", cost).drop("price_in", "price_out")


def usage(priced: DataFrame) -> DataFrame:
    """Per run: tokens, cost, unpriced calls; the cost is unknown when nothing had a price."""
    summed = priced.groupBy("run_id").agg(
        F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("total_tokens"),
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("__cost"),
        F.count_if(F.col("cost_usd").isNull()).alias("unpriced_calls"),
    )
    nothing = (F.col("unpriced_calls") > 0) & (F.col("__cost") == 0)
    return summed.select(
        "run_id",
        "total_tokens",
        F.when(~nothing, F.col("__cost")).alias("estimated_cost_usd"),
        (F.col("unpriced_calls") == 0).alias("cost_complete"),
        "unpriced_calls",
    )


def current_decisions(log: DataFrame) -> DataFrame:
    """(finding_id, seq, decision, decided_at) → the last decision; a pending one has no time."""
    last = log.groupBy("finding_id").agg(F.max_by(F.struct("decision", "decided_at"), "seq").alias("last"))
    return last.select(
        "finding_id",
        F.col("last.decision").alias("decision"),
        F.when(F.col("last.decision") != "PENDING", F.col("last.decided_at")).alias("decided_at"),
    )


def active_runs(assessments: DataFrame) -> DataFrame:
    """Unfinished assessments per circular, manual and date, a missing date being a value of its own."""
    return (
        assessments.where(F.col("status").isin("PENDING", "RUNNING"))
        .groupBy("circular_id", "policy_pack_id", "as_of_date")
        .agg(F.count("*").alias("active"), F.min("id").alias("first_id"))
        .withColumn("duplicated", F.col("active") > 1)
    )


def fail_interrupted(assessments: DataFrame, steps: DataFrame, reason: str, at: Column) -> tuple[DataFrame, DataFrame]:
    """Unfinished assessments become FAILED and their running steps ERROR, with reason and time."""
    open_ = F.col("status").isin("PENDING", "RUNNING")
    failed = assessments.withColumns(
        {
            "status": F.when(open_, "FAILED").otherwise(F.col("status")),
            "error_reason": F.when(open_, reason),
            "completed_at": F.when(open_, at),
        }
    )
    hit = assessments.where(open_).select(F.col("id").alias("run_id"), F.lit(True).alias("__hit"))
    stopped = F.coalesce(F.col("__hit"), F.lit(False)) & (F.col("status") == "RUNNING")
    ended = steps.join(hit, "run_id", "left")
    return failed, ended.select(
        *[c for c in steps.columns if c != "status"],
        F.when(stopped, "ERROR").otherwise(F.col("status")).alias("status"),
        F.when(stopped, reason).alias("error"),
        F.when(stopped, at).alias("finished_at"),
    )


def _ranges(start: Column, end: Column) -> Column:
    return F.explode(
        F.sequence(
            F.floor(start / PLACE_WIDTH), F.greatest(F.floor((end - 1) / PLACE_WIDTH), F.floor(start / PLACE_WIDTH))
        )
    )


def meeting_paragraphs(spans: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Spans (span_id, circular_id, start, end) with every paragraph of their circular they meet.

    Both sides are cut into ranges of positions, so a long circular is many keys and only
    neighbours in position are compared; a pair is kept in the first range both touch.
    """
    p = paragraphs.select(
        "circular_id",
        "order_index",
        "para_number",
        F.col("char_start").alias("p_start"),
        F.col("char_end").alias("p_end"),
        _ranges(F.col("char_start"), F.col("char_end")).alias("range"),
    )
    s = spans.withColumn("range", _ranges(F.col("start"), F.col("end")))
    first = F.greatest(F.floor(F.col("start") / PLACE_WIDTH), F.floor(F.col("p_start") / PLACE_WIDTH))
    return (
        s.join(p, ["circular_id", "range"])
        .where((F.col("start") < F.col("p_end")) & (F.col("end") > F.col("p_start")) & (F.col("range") == first))
        .drop("range")
    )


def findings_reading_order(findings: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Findings by obligation in document order, labelled by paragraph number or place.

    Needs assessment_id, circular_id, obligation_id, obligation_start, impact_type, clause_number.
    Reading order is (assessment_id, group_index, impact_rank, clause_letter, clause_digits).
    """
    groups = findings.select("assessment_id", "circular_id", "obligation_id", "obligation_start").distinct()
    numbered = running_count(
        groups,
        ["assessment_id"],
        {"range": F.floor(F.col("obligation_start") / 65536)},
        ["obligation_start", "obligation_id"],
        "group_index",
    )
    points = numbered.select(
        "assessment_id",
        "obligation_id",
        "group_index",
        "circular_id",
        F.col("obligation_start").alias("start"),
        (F.col("obligation_start") + 1).alias("end"),
    )
    inside = (
        meeting_paragraphs(points, paragraphs)
        .groupBy("assessment_id", "obligation_id")
        .agg(F.min_by("para_number", "order_index").alias("para_number"))
    )
    labels = numbered.join(inside, ["assessment_id", "obligation_id"], "left").select(
        "assessment_id",
        "obligation_id",
        "group_index",
        F.coalesce(F.concat(F.lit("¶"), "para_number"), F.col("group_index").cast("string")).alias("label"),
    )
    rank = F.array_position(F.array(*[F.lit(i) for i in K.IMPACT_READING_ORDER]), F.col("impact_type"))
    return findings.join(labels, ["assessment_id", "obligation_id"]).withColumns(
        {
            "impact_rank": rank,
            "clause_letter": F.regexp_extract("clause_number", r"^([A-Z]*)", 1),
            "clause_digits": F.regexp_extract("clause_number", r"(\d+)$", 1).try_cast("long"),
        }
    )


def evidence_window(findings: DataFrame, paragraphs: DataFrame, radius: int = 1) -> DataFrame:
    """Paragraphs around each finding's evidence and the part of the span inside each.

    Needs id, circular_id, the located span or else the obligation's span.
    """
    spans = findings.select(
        F.col("id").alias("span_id"),
        "circular_id",
        F.coalesce("circular_span_start", "obligation_start").alias("start"),
        F.coalesce("circular_span_end", "obligation_end").alias("end"),
    )
    first = (
        meeting_paragraphs(spans, paragraphs)
        .groupBy("span_id", "circular_id", "start", "end")
        .agg(F.min("order_index").alias("first_index"))
    )
    wanted = first.withColumn(
        "order_index",
        F.explode(F.sequence(F.greatest(F.col("first_index") - radius, F.lit(0)), F.col("first_index") + radius)),
    )
    p = paragraphs.select("circular_id", "order_index", "char_start", "char_end")
    low, high = F.greatest("start", "char_start"), F.least("end", "char_end")
    return wanted.join(p, ["circular_id", "order_index"]).select(
        F.col("span_id").alias("finding_id"),
        "order_index",
        F.when(low < high, low).alias("mark_start"),
        F.when(low < high, high).alias("mark_end"),
    )


def step_sequence(steps: DataFrame) -> DataFrame:
    """Gap-free numbers per run in order of start; a long run is numbered hour by hour."""
    return running_count(
        steps, ["run_id"], {"hour": F.date_trunc("hour", "started_at")}, ["started_at", "id"], "seq"
    )


def trace_view(steps: DataFrame) -> DataFrame:
    """Typed fields out of the JSON inputs; a value of another type reads as missing."""
    field = lambda name: F.get_json_object("inputs", f"$.{name}")
    return steps.select(
        "run_id",
        "id",
        "node",
        "status",
        (F.coalesce("tokens_in", F.lit(0)) + F.coalesce("tokens_out", F.lit(0))).alias("tokens"),
        field("obligation_id").try_cast("long").alias("obligation_id"),
        field("clause_number").alias("clause_number"),
        field("attempt").try_cast("long").alias("attempt"),
    )


def node_latency(steps: DataFrame) -> DataFrame:
    return steps.groupBy("run_id", "node").agg(
        F.count("*").alias("calls"), F.avg("latency_ms").alias("mean_latency_ms")
    )


def eval_history(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Runs with their results, one row per result; newest first is (started_on desc, run_id desc)."""
    return runs.join(results, "run_id", "left")


def latest_finished(runs: DataFrame) -> DataFrame:
    """Newest finished run per suite and mode."""
    done = runs.where(F.col("finished_on").isNotNull())
    return first_per_key(done, ["suite", "mode"], [F.col("started_on").desc(), F.col("run_id").desc()])


def metric_history(runs: DataFrame, results: DataFrame, metric: str) -> DataFrame:
    """(run, commit, value) of one metric over all runs."""
    named = results.where(F.col("metric_name") == metric).select("run_id", "metric_value")
    return runs.select("run_id", "git_sha", "started_on").join(named, "run_id")


def paragraph_vision_share(paragraphs: DataFrame) -> DataFrame:
    """Share of paragraphs read by the vision path per circular."""
    return paragraphs.groupBy("circular_id").agg(
        F.coalesce(F.avg(F.when(F.col("extraction_method") == "vision", 1.0).otherwise(0.0)), F.lit(0.0)).alias(
            "vision_fraction"
        )
    )
