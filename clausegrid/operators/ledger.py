"""Human review of findings and passages: what counts, what is stale, what is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions import fixed as K
from clausegrid.functions import text as T
from clausegrid.functions.ranking import first_per_key
from clausegrid.operators.evaluation import cohens_kappa

# --- relevance annotations -------------------------------------------------------------------


def annotation_problems(records: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(question_id, problem) for everything that makes a record unusable as evidence.

    Records: question_id, relevance, ambiguity, review_status, reviewer_type, reviewed_at, split,
    family, document, char_start, char_end, quote, quote_sha256. Texts: document, text. Each
    record's checks leave one pass; only the duplicate and text checks need another table.
    """
    reviewed = F.col("review_status") == "reviewed"
    checks = [
        (~F.col("relevance").isin(*K.RELEVANCE_LABELS), "relevance is not a known label"),
        (~F.col("ambiguity").isin(*K.AMBIGUITY_LABELS), "ambiguity is not a known label"),
        (reviewed & ~F.coalesce(F.col("reviewer_type") == "human", F.lit(False)), "marked reviewed without a human reviewer"),
        (reviewed & F.col("reviewed_at").isNull(), "marked reviewed without a review time"),
        (F.col("split") != T.family_split(F.col("family")), "split disagrees with its family's split"),
        (F.sha2("quote", 256) != F.col("quote_sha256"), "quote text does not match its recorded hash"),
    ]
    kept = [F.when(F.coalesce(bad, F.lit(False)), F.lit(message)) for bad, message in checks]
    own = records.select("question_id", F.explode(F.array_compact(F.array(*kept))).alias("problem"))
    twice = (
        records.groupBy("question_id")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select("question_id", F.explode(F.expr("sequence(2, n)")).alias("__i"))
        .select("question_id", F.lit("duplicate question id").alias("problem"))
    )
    found = own.unionByName(twice)
    if texts is None:
        return found
    joined = records.join(texts.select("document", F.col("text").alias("__t")), "document", "left")
    at = T.sliced(F.col("__t"), F.col("char_start"), F.col("char_end"))
    problem = F.when(F.col("__t").isNull(), "document is not ingested").when(
        at != F.col("quote"), "offsets no longer point at the quoted passage"
    )
    moved = joined.select("question_id", problem.alias("problem")).where("problem IS NOT NULL")
    return found.unionByName(moved)


def annotation_status(records: DataFrame) -> DataFrame:
    """(field, value, n): counts by review status, annotator type, relevance and split."""
    fields = ("review_status", "annotator_type", "relevance", "split")
    stacked = records.select(
        F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields]))
    )
    counts = stacked.groupBy("field", "value").agg(F.count("*").alias("n"))
    documents = records.agg(F.countDistinct("document").alias("n")).select(
        F.lit("documents").alias("field"), F.lit("distinct").alias("value"), "n"
    )
    return counts.unionByName(documents)


def reviewed_hit_rate(records: DataFrame, retrieved: DataFrame, k: int = 10) -> DataFrame:
    """Hit rate over reviewed questions; retrieved is (question_key, document, rank).

    A question is the first two parts of the record id, and is answered when any of its relevant
    documents is among the first k.
    """
    counted = records.where((F.col("review_status") == "reviewed") & (F.col("relevance") != "not_relevant"))
    keyed = counted.select(F.substring_index("question_id", "-", 2).alias("question_key"), "document")
    hits = (
        keyed.join(retrieved.where(F.col("rank") <= k).select("question_key", "document"), ["question_key", "document"], "left_semi")
        .select("question_key")
        .distinct()
        .agg(F.count("*").alias("__hits"))
    )
    sizes = keyed.agg(F.count("*").alias("reviewed_records"), F.countDistinct("question_key").alias("questions"))
    ignored = records.agg(F.count_if(F.col("review_status") == "provisional").alias("provisional_records_ignored"))
    one = F.lit(1).alias("__one")
    joined = sizes.select("*", one).join(hits.select("*", one), "__one").join(ignored.select("*", one), "__one")
    rate = F.when(F.col("questions") > 0, F.col("__hits") / F.col("questions"))
    return joined.select("reviewed_records", "questions", "provisional_records_ignored", rate.alias("hit_rate"))


# --- review of findings -------------------------------------------------------------------------


def review_problem() -> Column:
    """Why a review row can never count, null when it can (a stale one is not a problem)."""
    zoned = F.col("reviewed_at").rlike(r"^\d{4}-\d{2}-\d{2}[T ].*(Z|[+-]\d{2}:?\d{2})$") & F.col(
        "reviewed_at"
    ).try_cast("timestamp").isNotNull()
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(F.col("record_id").isNull(), "no record_id")
        .when(no(F.col("label").isin(*K.REVIEW_LABELS)), "label is not a known label")
        .when(no(F.col("reviewer_type") == "human"), "the reviewer is not recorded as a human")
        .when(no(T.strip(F.col("reviewer_id")) != ""), "the reviewer has no name")
        .when(no(zoned), "reviewed_at is not an ISO time with a timezone")
        .when(F.col("snapshot_sha256").isNull(), "no snapshot_sha256")
    )


def review_ledger(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Every review row with its state: invalid (and why), stale, replaced or current.

    Candidates: record_id, snapshot_sha256. Reviews: line, record_id, label, reviewer_id,
    reviewer_type, reviewed_at, snapshot_sha256. A later valid row for the same snapshot
    replaces an earlier one; a later stale one does not.
    """
    c = candidates.select("record_id", F.col("snapshot_sha256").alias("__now"))
    checked = reviews.withColumn("problem", review_problem()).join(c, "record_id", "left")
    checked = checked.withColumn(
        "problem",
        F.coalesce("problem", F.when(F.col("__now").isNull(), F.concat(F.lit("no candidate "), "record_id"))),
    )
    fits = F.col("problem").isNull() & (F.col("snapshot_sha256") == F.col("__now"))
    last = (
        checked.where(fits)
        .groupBy("record_id")
        .agg(F.max("line").alias("__last"))
    )
    joined = checked.join(last, "record_id", "left")
    state = (
        F.when(F.col("problem").isNotNull(), "invalid")
        .when(F.col("snapshot_sha256") != F.col("__now"), "stale")
        .when(F.col("line") == F.col("__last"), "current")
        .otherwise("replaced")
    )
    return joined.withColumn("state", state).drop("__now", "__last")


def current_reviews(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("state") == "current").select("record_id", "label")


def pending_candidates(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    return candidates.join(current_reviews(ledger), "record_id", "left_anti")


def support_summary(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per generator and corpus: candidates, labels, and the supported share of decisive reviews."""
    joined = candidates.join(current_reviews(ledger), "record_id", "left")
    label = lambda v: F.count_if(F.col("label") == v)
    summed = joined.groupBy("generator", "corpus").agg(
        F.count("*").alias("candidates"),
        *[label(v).alias(v) for v in K.REVIEW_LABELS],
        F.count("label").alias("reviewed"),
        label("supported").cast("double").alias("__yes"),
        (label("supported") + label("unsupported")).alias("decisive"),
    )
    interval = T.wilson_interval(F.col("__yes"), F.col("decisive").cast("double"))
    return summed.withColumns(
        {
            "supported_share": F.when(F.col("decisive") > 0, F.col("__yes") / F.col("decisive")),
            "share_low": interval["low"],
            "share_high": interval["high"],
        }
    ).drop("__yes")


def judged_pairs(candidates: DataFrame, ledger: DataFrame, judgements: DataFrame) -> DataFrame:
    """Judge labels with the human label, or the first reason the row is left out."""
    c = candidates.select("record_id", F.col("snapshot_sha256").alias("__now"))
    h = current_reviews(ledger).withColumnRenamed("label", "human_label")
    joined = judgements.join(c, "record_id", "left").join(h, "record_id", "left")
    unclear = (F.col("label") == "insufficient") | (F.col("human_label") == "insufficient")
    excluded = (
        F.when(F.col("__now").isNull(), "unknown record")
        .when(~F.coalesce(F.col("snapshot_sha256") == F.col("__now"), F.lit(False)), "judged another snapshot")
        .when(~F.coalesce(F.col("label").isin(*K.REVIEW_LABELS), F.lit(False)), "judge label not recognised")
        .when(F.col("human_label").isNull(), "no current human review")
        .when(unclear, "insufficient or ambiguous")
    )
    return joined.withColumn("excluded", excluded).drop("__now")


def judge_comparison(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(agreement of the decisive pairs, counts of the rows left out by reason)."""
    decisive = pairs.where(F.col("excluded").isNull()).select(
        (F.col("label") == "supported").alias("judge_supported"),
        (F.col("human_label") == "supported").alias("human_supported"),
    )
    reasons = pairs.where(F.col("excluded").isNotNull()).groupBy("excluded").agg(F.count("*").alias("n"))
    return cohens_kappa(decisive), reasons


def offset_drift(candidates: DataFrame, texts: DataFrame, clauses: DataFrame) -> DataFrame:
    """Stored quotations that no longer sit at their offsets: (record_id, side, problem).

    Candidates: record_id, document, document_sha256, char_start, char_end, quote, clause_key,
    clause_text, clause_quote, clause_start, clause_end. Texts: document, checksum, text.
    Clauses: clause_key, text.
    """
    t = texts.select("document", F.col("checksum").alias("__sum"), F.col("text").alias("__t"))
    p = clauses.select("clause_key", F.col("text").alias("__c"))
    joined = candidates.join(t, "document", "left").join(p, "clause_key", "left")
    circular = (
        F.when(F.col("__t").isNull(), "the circular is not stored")
        .when(~F.col("__sum").eqNullSafe(F.col("document_sha256")), "the circular's file checksum differs")
        .when(
            T.sliced(F.col("__t"), F.col("char_start"), F.col("char_end")) != F.col("quote"),
            "circular offsets no longer point at the quotation",
        )
    )
    policy = (
        F.when(F.col("__c").isNull(), "the clause is not stored")
        .when(F.col("__c") != F.col("clause_text"), "the clause text has changed")
        .when(
            T.sliced(F.col("__c"), F.col("clause_start"), F.col("clause_end")) != F.col("clause_quote"),
            "clause offsets no longer point at the quotation",
        )
    )
    both = F.array(
        F.struct(F.lit("circular").alias("side"), circular.alias("problem")),
        F.struct(F.lit("policy").alias("side"), policy.alias("problem")),
    )
    return joined.select("record_id", F.inline(both)).where("problem IS NOT NULL")


def snapshot_export(
    findings: DataFrame,
    assessments: DataFrame,
    circulars: DataFrame,
    obligations: DataFrame | None,
    packs: DataFrame,
    clauses: DataFrame,
    runs: DataFrame,
) -> DataFrame:
    """Findings with located quotes as review records with a hash of everything shown.

    ``runs`` (assessment_id, provider, model, graph_version) says what made the findings.
    Rows are flat until the last projection; the JSON text has its keys sorted and the hash is
    taken over that text. Quotes come from the obligation and the clause the spans lie in. Without
    ``obligations`` the findings carry obligation_text and obligation_start. What belongs to an
    assessment is put together first, so findings meet it, and their clauses, once.
    """
    a = assessments.where(F.col("status").isin(*K.TERMINAL_STATUSES)).select(
        F.col("id").alias("assessment_id"), "run_id", F.col("status").alias("run_status"), "circular_id", "policy_pack_id"
    )
    k = circulars.select(
        F.col("id").alias("circular_id"), "circular_number", "title", "source_url", "checksum"
    )
    g = packs.select(F.col("id").alias("policy_pack_id"), F.col("name").alias("pack"), "version")
    c = clauses.select(
        F.col("id").alias("policy_clause_id"), "clause_number", F.col("heading").alias("heading"), F.col("text").alias("clause_text")
    )
    located = findings.where(
        (F.col("quote_status") == "VERIFIED")
        & F.col("circular_span_start").isNotNull()
        & F.col("policy_clause_id").isNotNull()
    )
    if obligations is None:
        located = located.withColumnsRenamed({"obligation_text": "obligation", "obligation_start": "__os"})
    else:
        o = obligations.select(
            F.col("id").alias("obligation_id"), F.col("text").alias("obligation"), F.col("char_start").alias("__os")
        )
        located = located.join(o, "obligation_id")
    shown = a.join(runs, "assessment_id").join(k, "circular_id").join(g, "policy_pack_id").drop("circular_id", "policy_pack_id")
    rows = located.join(shown, "assessment_id").join(c, "policy_clause_id")
    by_rule = F.col("provider") == "deterministic"
    start = (F.col("circular_span_start") - F.col("__os")).cast("int")
    end = (F.col("circular_span_end") - F.col("__os")).cast("int")
    corpus = F.when(F.coalesce("source_url", F.lit("")).startswith("synthetic://"), "synthetic").otherwise("real")
    payload = F.struct(
        F.struct(F.col("run_id"), F.col("run_status").alias("status")).alias("assessment"),
        F.struct(
            F.col("circular_span_end").alias("char_end"),
            F.col("circular_span_start").alias("char_start"),
            F.col("circular_number"),
            corpus.alias("corpus"),
            F.col("checksum").alias("document_sha256"),
            F.col("obligation"),
            T.sliced(F.col("obligation"), start, end).alias("quote"),
            F.col("source_url"),
            F.col("title"),
        ).alias("circular"),
        F.struct(
            F.col("id").alias("finding_id"), F.col("impact_type"), F.col("quote_status"), F.col("rationale")
        ).alias("finding"),
        F.struct(
            by_rule.alias("deterministic"),
            F.col("graph_version"),
            F.col("model"),
            F.when(by_rule, "deterministic rule-based judge").otherwise("real model").alias("output"),
            F.col("provider"),
        ).alias("generator"),
        F.lit("assessment_finding").alias("kind"),
        F.struct(F.col("clause_number"), F.col("clause_text"), F.col("heading"), F.col("pack"), F.col("version")).alias("policy"),
    )
    text = F.to_json(payload, {"ignoreNullFields": "false"})
    return rows.select(
        F.concat_ws("/", "run_id", F.col("id").cast("string")).alias("record_id"), corpus.alias("corpus"), text.alias("snapshot")
    ).withColumn("snapshot_sha256", F.sha2("snapshot", 256))


def upsert_candidates(stored: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged candidates, one report row): a fresh record takes the place of a stored one."""
    columns = fresh.columns
    both = stored.select(*columns, F.lit(0).alias("__new")).unionByName(fresh.select(*columns, F.lit(1).alias("__new")))
    merged = first_per_key(both, ["record_id"], [F.col("__new").desc()]).drop("__new")
    # Counting needs the hashes only.
    fresh = fresh.select("record_id", "snapshot_sha256")
    old = stored.select("record_id", F.col("snapshot_sha256").alias("__was"))
    report = fresh.join(old, "record_id", "left").agg(
        F.count("*").alias("exported"), F.count_if(F.col("__was") != F.col("snapshot_sha256")).alias("replaced")
    )
    return merged, report
