"""Obligations against policy clauses: candidates, verdicts, verified findings, memo, outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from clausegrid.functions import fixed as K
from clausegrid.functions import text as T
from clausegrid.functions.ranking import first_per_key, top_n
from clausegrid.functions.scan import running_totals
from clausegrid.session import cut_lineage


def plan_assessments(assessments: DataFrame, obligations: DataFrame) -> DataFrame:
    """One task per assessment and obligation of its circular, with the obligation's place."""
    a = assessments.select(F.col("id").alias("assessment_id"), "circular_id", "policy_pack_id")
    o = obligations.select(
        F.col("id").alias("obligation_id"), "circular_id", "text", "char_start", "char_end"
    )
    return a.join(o, "circular_id")


# --- candidate clauses --------------------------------------------------------------------


#: Characters of distinct texts up to which what was found for them is sent to every task.
BROADCAST_CHARS = 8_000_000


def rank_clauses(
    tasks: DataFrame,
    clauses: DataFrame,
    threshold: float = K.RELEVANCE_THRESHOLD,
    n: int = K.CLAUSES_PER_OBLIGATION,
) -> tuple[DataFrame, DataFrame]:
    """(the top n clauses at or above the threshold per task, the tasks left without any).

    The score is the share of the obligation's content words found in the clause. Equal word
    sets are scored once per manual. To reach the threshold a clause must hold one of the
    obligation's rarest words (all but the ``needed - 1`` most common ones), so only those are
    joined: no clause that could qualify is missed and common words never meet. Tasks without a
    candidate name their closest clause, found by the same reasoning with two shared words, then
    one, then none.
    """
    found, lonely = _ranked(tasks, clauses, threshold, n)
    wanted = tasks.withColumn("__letters", T.letters(F.col("text")))
    keys = ["policy_pack_id", "__letters"]
    return wanted.join(_small(found.drop("terms")), keys).drop("__letters"), wanted.join(_small(lonely), keys).drop("__letters")


def _ranked(tasks: DataFrame, clauses: DataFrame, threshold: float, n: int) -> tuple[DataFrame, DataFrame]:
    """``rank_clauses`` for each manual and distinct letters of a text, which decide the words: (found, lonely)."""
    letters = T.letters(F.col("text")).alias("__letters")
    texts = cut_lineage(
        tasks.select("policy_pack_id", letters).distinct().withColumn("terms", T.content_terms(F.col("__letters")))
    )
    asked = texts.select("policy_pack_id", "terms").distinct()
    offered = clauses.select(
        "policy_pack_id", F.col("id").alias("clause_id"), T.content_terms(F.col("text")).alias("clause_terms")
    )
    sets = (
        top_n(offered, ["policy_pack_id", "clause_terms"], [F.col("clause_id").asc()], n)
        .groupBy("policy_pack_id", "clause_terms")
        .agg(F.array_sort(F.collect_list("clause_id")).alias("clause_ids"))
    )
    # The words of a manual are read for each branch; its distinct sets are few.
    sets = cut_lineage(sets)
    ordered = cut_lineage(_rarest_first(asked, sets))
    needed = F.greatest(F.ceil(F.round(F.lit(threshold) * F.size("terms"), 9)), F.lit(1)).cast("int")
    close = _sharing(ordered, sets, needed).where(F.col("score") >= threshold)
    best = top_n(
        close.withColumn("clause_id", F.explode("clause_ids")),
        ["policy_pack_id", "terms"],
        [F.col("score").desc(), F.col("clause_id").asc()],
        n,
    ).select("policy_pack_id", "terms", "clause_id", "score", "rank")
    best = cut_lineage(best)
    keys = ["policy_pack_id", "terms"]
    found = cut_lineage(texts.join(best, keys))
    alone = ordered.join(best.select(*keys), keys, "left_anti")
    closest = _closest(alone, sets)
    lonely = cut_lineage(texts.join(alone.select(*keys), keys, "left_semi").join(closest, keys, "left").drop("terms"))
    return found, lonely


def _small(found: DataFrame) -> DataFrame:
    """Marked for a broadcast when its texts are few; more are joined by shuffling."""
    chars = found.agg(F.sum(F.length("__letters") + 64)).first()[0] or 0
    return F.broadcast(found) if chars <= BROADCAST_CHARS else found


def _named(clauses: DataFrame, ids: DataFrame) -> DataFrame:
    """The clauses of the given ids; marked for a broadcast when they are few."""
    once = cut_lineage(ids.where(F.col("id").isNotNull()).distinct())
    kept = cut_lineage(clauses.join(once, "id", "left_semi"))
    chars = kept.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    return F.broadcast(kept) if chars <= BROADCAST_CHARS else kept


def candidate_pairs(
    tasks: DataFrame,
    clauses: DataFrame,
    threshold: float = K.RELEVANCE_THRESHOLD,
    n: int = K.CLAUSES_PER_OBLIGATION,
) -> tuple[DataFrame, DataFrame]:
    """(pairs with what a verdict needs to know of both sides, no-match findings of the tasks left).

    The tasks carry their texts, and few clauses are candidates of any text, so no pair is shuffled when the distinct
    texts are few. What is read from an obligation is read once for it, from a clause once for it.
    """
    found, lonely = _ranked(tasks, clauses, threshold, n)
    keys = ["policy_pack_id", "__letters"]
    wanted = tasks.withColumn("__letters", T.letters(F.col("text")))
    asked = obligation_features(
        wanted.withColumnsRenamed({"text": "obligation_text", "char_start": "obligation_start"})
    )
    offered = _named(clauses, found.select(F.col("clause_id").alias("id"))).select(
        F.col("id").alias("policy_clause_id"), "clause_number", F.col("text").alias("clause_text"), F.col("char_start").alias("clause_start")
    )
    chars = offered.agg(F.sum(F.length("clause_text") + 64)).first()[0] or 0
    offered = cut_lineage(clause_features(offered))
    # Words are compared once for each distinct text and clause, not for each obligation.
    judged = found.withColumnsRenamed({"clause_id": "policy_clause_id", "terms": "o_terms"})
    judged = pair_scores(judged.join(offered.select("policy_clause_id", "c_terms", "c_sentences"), "policy_clause_id"))
    judged = cut_lineage(judged.drop("o_terms", "c_terms", "c_sentences"))
    offered = offered.drop("c_terms", "c_sentences")
    pairs = (
        asked.drop("o_terms")
        .join(_small(judged), keys)
        .join(F.broadcast(offered) if chars <= BROADCAST_CHARS else offered, "policy_clause_id")
        .drop("__letters")
    )
    closest = _named(clauses, lonely.select(F.col("closest_id").alias("id")))
    unmatched = wanted.join(_small(lonely), keys).drop("__letters")
    return pairs, no_candidate_findings(unmatched, closest, threshold)


def _rarest_first(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """Adds ``by_rarity``: the set's words ordered by how many clause word sets hold them."""
    df = sets.select(F.explode("clause_terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    words = asked.select("policy_pack_id", "terms", F.explode_outer("terms").alias("term")).join(
        df, "term", "left"
    )
    order = F.when(F.col("term").isNotNull(), F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term"))
    return words.groupBy("policy_pack_id", "terms").agg(
        F.array_sort(F.collect_list(order))["term"].alias("by_rarity")
    )


def _sharing(ordered: DataFrame, sets: DataFrame, needed: Column) -> DataFrame:
    """Pairs of word sets in one manual that share at least ``needed`` words, each found once."""
    prefix = F.slice("by_rarity", F.lit(1), F.greatest(F.size("terms") - needed + 1, F.lit(0)))
    left = ordered.withColumn("prefix", prefix).withColumn("term", F.explode("prefix"))
    right = sets.withColumn("term", F.explode("clause_terms"))
    met = left.join(right, ["policy_pack_id", "term"])
    first_met = F.element_at(F.filter("prefix", lambda t: F.array_contains(F.col("clause_terms"), t)), 1)
    shared = F.size(F.array_intersect("terms", "clause_terms"))
    return (
        met.where(first_met == F.col("term"))
        .withColumn("shared", shared)
        .where(F.col("shared") >= needed)
        .select(
            "policy_pack_id",
            "terms",
            "clause_terms",
            "clause_ids",
            "shared",
            (F.col("shared") / F.size("terms")).alias("score"),
        )
    )


def _closest(lonely: DataFrame, sets: DataFrame) -> DataFrame:
    """The best clause of word sets that have no candidate, lowest id on ties."""
    keys = ["policy_pack_id", "terms"]
    two = _sharing(lonely, sets, F.lit(2)).select(
        *keys, F.col("shared").cast("int").alias("shared"), F.element_at("clause_ids", 1).alias("clause_id")
    )
    lowest = (
        sets.select("policy_pack_id", F.explode("clause_terms").alias("term"), F.element_at("clause_ids", 1).alias("clause_id"))
        .groupBy("policy_pack_id", "term")
        .agg(F.min("clause_id").alias("clause_id"))
    )
    one = (
        lonely.select(*keys, F.explode("terms").alias("term"))
        .join(lowest, ["policy_pack_id", "term"])
        .select(*keys, F.lit(1).alias("shared"), "clause_id")
    )
    any_ = sets.groupBy("policy_pack_id").agg(F.min(F.element_at("clause_ids", 1)).alias("clause_id"))
    none = lonely.select(*keys).join(any_, "policy_pack_id").select(*keys, F.lit(0).alias("shared"), "clause_id")
    best = (
        two.unionByName(one)
        .unionByName(none)
        .groupBy(*keys)
        .agg(F.max(F.struct("shared", (-F.col("clause_id")).alias("back"))).alias("best"))
    )
    return best.select(
        *keys,
        (-F.col("best.back")).alias("closest_id"),
        F.when(F.size("terms") > 0, F.col("best.shared") / F.size("terms")).otherwise(0.0).alias("closest_score"),
    )


# --- verdicts -----------------------------------------------------------------------------


def obligation_features(rows: DataFrame, text: str = "obligation_text") -> DataFrame:
    """What a verdict needs to know of an obligation; worked out once per obligation, not per pair."""
    body = F.col(text)
    staged = rows.withColumns({"o_terms": T.content_terms(body), "o_limit": T.stated_quantity(body)})
    limit = F.col("o_limit.matched")
    return staged.withColumns(
        {
            "o_bans": T.prohibits(body),
            "o_permits": T.permits(body),
            "o_quote": T.trim_quote(body),
            "o_limit_quote": F.when(limit.isNotNull(), T.sentence_around(T.clause_sentences(body), limit)),
        }
    )


def clause_features(rows: DataFrame, text: str = "clause_text") -> DataFrame:
    """What a verdict needs to know of a clause: its words, limit and sentences with theirs."""
    body = F.col(text)
    staged = rows.withColumns(
        {
            "c_terms": T.content_terms(body),
            "c_limit": T.stated_quantity(body),
            "__sentences": T.clause_sentences(body),
        }
    )
    limit = F.col("c_limit.matched")
    known = F.transform(
        "__sentences",
        lambda s: F.struct(
            (-s["start"]).alias("back"),
            T.trim_quote(s["piece"]).alias("piece"),
            T.content_terms(s["piece"]).alias("terms"),
        ),
    )
    return staged.withColumns(
        {
            "c_sentences": F.transform(
                known,
                lambda s: F.struct(
                    s["back"].alias("back"),
                    s["piece"].alias("piece"),
                    s["terms"].alias("terms"),
                    T.prohibits(s["piece"]).alias("bans"),
                    T.permits(s["piece"]).alias("permits"),
                ),
            ),
            "c_limit_quote": F.when(limit.isNotNull(), T.sentence_around(F.col("__sentences"), limit)),
        }
    ).drop("__sentences")


def pair_scores(pairs: DataFrame) -> DataFrame:
    """Adds the share of the obligation's words in the clause and the clause's sentence with most of them."""
    shared = F.size(F.array_intersect("o_terms", "c_terms"))
    scored = F.transform(
        "c_sentences",
        lambda s: F.struct(
            F.size(F.array_intersect(s["terms"], F.col("o_terms"))).alias("score"),
            s["back"].alias("back"),
            s["piece"].alias("piece"),
            s["bans"].alias("bans"),
            s["permits"].alias("permits"),
        ),
    )
    return pairs.withColumns(
        {
            "p_overlap": F.when(F.size("o_terms") > 0, shared / F.size("o_terms")).otherwise(0.0),
            "p_best": F.array_max(F.filter(scored, lambda s: s["score"] > 0)),
        }
    )


def judge_pairs(pairs: DataFrame) -> DataFrame:
    """(…, obligation_text, clause_text, clause_number) → impact, rationale, confidence and quotes.

    Rows that carry the features of both sides and their scores are judged by comparing flags only;
    otherwise they are worked out here.
    """
    kept = [c for c in pairs.columns if not c.startswith(("o_", "c_", "p_"))]
    staged = pairs if "o_bans" in pairs.columns else obligation_features(pairs)
    staged = staged if "c_limit" in staged.columns else clause_features(staged)
    staged = staged if "p_best" in staged.columns else pair_scores(staged)
    overlap, best = F.col("p_overlap"), F.col("p_best.piece")
    open_side = F.when(F.col("o_bans"), F.col("p_best.permits")).otherwise(F.col("o_permits"))
    other_limit = (F.col("o_limit.unit") == F.col("c_limit.unit")) & (F.col("o_limit.value") != F.col("c_limit.value"))
    impact = (
        F.when((overlap < K.NO_MATCH_BELOW) | best.isNull(), "NO_MATCH")
        .when(F.coalesce(other_limit, F.lit(False)), "MODIFIED")
        .when((F.col("o_bans") != F.col("p_best.bans")) & (overlap >= K.CONFLICT_FROM) & open_side, "CONFLICT")
        .when(overlap >= K.COVERED_FROM, "ALREADY_COVERED")
        .otherwise("NEW_REQUIREMENT")
    )
    judged = staged.withColumn("impact_type", impact)
    share = F.concat(F.bround(overlap * 100).cast("int").cast("string"), F.lit("%"))
    forbids = F.when(F.col("o_bans"), "forbids").otherwise("allows")
    allows = F.when(F.col("o_bans"), "allows").otherwise("forbids")
    number = F.col("clause_number")

    # Fixed message texts, one per verdict.
    rationale = (
        F.when(
            F.col("impact_type") == "NO_MATCH",
            F.format_string(
                "Clause %s shares too few terms with the obligation (%s of its content words) "
                "to address the same requirement.",
                number,
                share,
            ),
        )
        .when(
            F.col("impact_type") == "MODIFIED",
            F.format_string(
                "Both texts set a limit in %s, but the obligation states %s while clause %s states "
                "%s; the clause needs its figure updated.",
                F.col("o_limit.unit"),
                T.strip(F.col("o_limit.matched")),
                number,
                T.strip(F.col("c_limit.matched")),
            ),
        )
        .when(
            F.col("impact_type") == "CONFLICT",
            F.format_string(
                "One text prohibits what the other permits: the obligation %s the conduct that "
                "clause %s %s.",
                forbids,
                number,
                allows,
            ),
        )
        .when(
            F.col("impact_type") == "ALREADY_COVERED",
            F.format_string(
                "Clause %s addresses the same requirement (%s of the obligation's content words "
                "recur in it) and states no conflicting figure.",
                number,
                share,
            ),
        )
        .otherwise(
            F.format_string(
                "Clause %s covers related ground but does not state this requirement; only part of "
                "the obligation's wording recurs in it.",
                number,
            )
        )
    )
    modified = F.col("impact_type") == "MODIFIED"
    return judged.select(
        *kept,
        "impact_type",
        rationale.alias("rationale"),
        F.bround(overlap, 2).alias("confidence"),
        F.when(modified, F.col("o_limit_quote")).otherwise(F.col("o_quote")).alias("circular_quote"),
        F.when(F.col("impact_type") == "NO_MATCH", "")
        .when(modified, F.col("c_limit_quote"))
        .otherwise(best)
        .alias("clause_quote"),
    )


def verify_grounding(judged: DataFrame) -> DataFrame:
    """Locate both quotes again; spans come back in the coordinates of the parent texts.

    Needs obligation_text, obligation_start, clause_text, clause_start. An empty quote is not
    looked for, a NO_MATCH verdict needs no clause quote, and a lost circular quote loses both.
    """
    found = judged.withColumns(
        {
            "__c": T.resolve_quote(F.col("circular_quote"), F.col("obligation_text")),
            "__p": T.resolve_quote(F.col("clause_quote"), F.col("clause_text")),
        }
    )
    quoted = F.coalesce(F.col("circular_quote"), F.lit("")) != ""
    clause_quoted = (F.coalesce(F.col("clause_quote"), F.lit("")) != "") & (F.col("impact_type") != "NO_MATCH")
    lost = quoted & F.col("__c").isNull()
    clause_lost = ~lost & clause_quoted & F.col("__p").isNull()
    clause_span = F.when(clause_quoted & ~lost, F.col("__p"))
    return found.select(
        *judged.columns,
        (F.col("obligation_start") + F.col("__c.start")).alias("circular_span_start"),
        (F.col("obligation_start") + F.col("__c.end")).alias("circular_span_end"),
        (F.col("clause_start") + clause_span["start"]).alias("clause_span_start"),
        (F.col("clause_start") + clause_span["end"]).alias("clause_span_end"),
        F.when(lost, K.CIRCULAR_QUOTE_PROBLEM).when(clause_lost, K.CLAUSE_QUOTE_PROBLEM).alias("problem"),
    )


def spans_in_context(rows: DataFrame) -> DataFrame:
    """(…, spans array, texts array) → whether every span occurs in the retrieved texts."""
    haystack = F.array_join("texts", "\n")
    return rows.withColumn(
        "in_context", F.forall("spans", lambda s: (s != "") & F.contains(haystack, s))
    )


FINDING_COLUMNS = [
    "assessment_id",
    "obligation_id",
    "policy_clause_id",
    "clause_number",
    "impact_type",
    "rationale",
    "confidence",
    "circular_span_start",
    "circular_span_end",
    "clause_span_start",
    "clause_span_end",
    "quote_status",
    "verification_note",
    "unlocated_quote",
    "verification_attempts",
]


def build_findings(verified: DataFrame, retries: int = K.MAX_VERIFICATION_RETRIES, tried_once: bool = False) -> DataFrame:
    """One finding per judged pair: its first attempt with both quotes located, else the last one.

    ``tried_once``: every pair has one attempt, so there is nothing to choose and nothing is shuffled.
    """
    ok = F.col("problem").isNull()
    allowed = verified.where(F.col("attempt") <= retries + 1)
    chosen = allowed if tried_once else first_per_key(
        allowed,
        ["assessment_id", "obligation_id", "policy_clause_id"],
        [ok.desc(), F.when(ok, F.col("attempt")).otherwise(-F.col("attempt")).asc()],
    )
    unlocated = F.when(
        ~ok,
        F.when(F.col("circular_span_start").isNull(), F.col("circular_quote")).otherwise(F.col("clause_quote")),
    )
    return chosen.withColumns(
        {
            "quote_status": F.when(ok, "VERIFIED").otherwise("FAILED"),
            "verification_note": F.col("problem"),
            "unlocated_quote": T.blank_to_null(unlocated),
            "verification_attempts": F.col("attempt"),
        }
    ).select(*FINDING_COLUMNS)


def no_candidate_findings(
    unmatched: DataFrame, clauses: DataFrame, threshold: float = K.RELEVANCE_THRESHOLD
) -> DataFrame:
    """Obligations no clause came close to: NO_MATCH without a judgement, the closest clause named."""
    named = unmatched.join(
        clauses.select(F.col("id").alias("closest_id"), F.col("clause_number").alias("__closest")),
        "closest_id",
        "left",
    )
    detail = F.when(
        F.col("__closest").isNotNull(),
        F.format_string(" The closest was %s at %.2f.", F.col("__closest"), F.col("closest_score")),
    ).otherwise(" The policy pack has no clauses.")
    head = (
        f"No policy clause scored at or above the relevance threshold ({threshold:.2f}) "
        "for this obligation, so no judgement was made."
    )
    nothing = {
        "policy_clause_id": "long",
        "clause_number": "string",
        "confidence": "double",
        "circular_span_start": "long",
        "circular_span_end": "long",
        "clause_span_start": "long",
        "clause_span_end": "long",
        "verification_note": "string",
        "unlocated_quote": "string",
    }
    return named.withColumns(
        {
            **{name: F.lit(None).cast(kind) for name, kind in nothing.items()},
            "impact_type": F.lit("NO_MATCH"),
            "rationale": F.concat(F.lit(head), detail),
            "quote_status": F.lit("NOT_APPLICABLE"),
            "verification_attempts": F.lit(0),
        }
    ).select(*FINDING_COLUMNS)


def assess(
    assessments: DataFrame,
    obligations: DataFrame,
    clauses: DataFrame,
    threshold: float = K.RELEVANCE_THRESHOLD,
    n: int = K.CLAUSES_PER_OBLIGATION,
) -> DataFrame:
    """Findings of every assessment: candidates, rule verdicts, verified quotes, no-match rows."""
    pairs, unmatched = candidate_pairs(plan_assessments(assessments, obligations), clauses, threshold, n)
    kept = ["assessment_id", "obligation_id", "policy_clause_id", "clause_number", "obligation_text", "obligation_start", "clause_text", "clause_start"]
    known = [c for c in pairs.columns if c.startswith(("o_", "c_", "p_"))]
    judged = judge_pairs(pairs.select(*kept, *known, F.lit(1).alias("attempt")))
    return build_findings(verify_grounding(judged), tried_once=True).unionByName(unmatched)


# --- model answers, memo, budget, outcome --------------------------------------------------

JUDGEMENT = S.StructType(
    [
        S.StructField("impact_type", S.StringType()),
        S.StructField("rationale", S.StringType()),
        S.StructField("confidence", S.DoubleType()),
        S.StructField("circular_span", S.StringType()),
        S.StructField("clause_span", S.StringType()),
    ]
)


def validate_judgements(answers: DataFrame) -> DataFrame:
    """(…, answer, refused) → the answer's fields and why it failed, null when it is usable."""
    from clausegrid.operators.extraction import unfence

    parsed = answers.withColumn("__j", F.from_json(unfence(F.col("answer")), JUDGEMENT))
    usable = (
        F.col("__j.impact_type").isin(*K.IMPACTS)
        & (F.length("__j.rationale") >= K.MIN_RATIONALE_CHARS)
        & F.col("__j.confidence").between(0.0, 1.0)
    )
    failure = F.when(F.col("refused"), "provider refused the request").when(
        ~F.coalesce(usable, F.lit(False)), "schema violation"
    )
    return parsed.withColumn("failure", failure).select(
        *answers.columns,
        F.when(F.col("failure").isNull(), F.col("__j.impact_type")).alias("impact_type"),
        F.when(F.col("failure").isNull(), F.col("__j.confidence")).alias("confidence"),
        F.when(F.col("failure").isNull(), F.coalesce("__j.circular_span", F.lit(""))).alias("circular_quote"),
        F.when(F.col("failure").isNull(), F.coalesce("__j.clause_span", F.lit(""))).alias("clause_quote"),
        "failure",
    )


def memo_summary(findings: DataFrame, numbers: DataFrame) -> DataFrame:
    """One memo per assessment with eligible findings; ``numbers`` names each assessment's circular.

    Distinct clauses are reduced before they are listed, so a list is bounded by the manual.
    """
    eligible = findings.where(F.col("quote_status").isin(*K.MEMO_ELIGIBLE))
    per_clause = (
        eligible.withColumn("clause", F.coalesce("clause_number", F.lit("no clause")))
        .groupBy("assessment_id", "impact_type", "clause")
        .agg(F.count("*").alias("n"), F.count_if(F.col("quote_status") == "VERIFIED").alias("located"))
    )

    def listed(impact: str) -> Column:
        clauses = F.array_sort(F.collect_set(F.when(F.col("impact_type") == impact, F.col("clause"))))
        return F.when(F.size(clauses) > 0, F.array_join(clauses, ", ")).otherwise("none")

    summed = per_clause.groupBy("assessment_id").agg(
        F.sum("n").alias("findings"),
        F.sum("located").alias("located"),
        F.sum(F.when(F.col("impact_type") == "NO_MATCH", F.col("n")).otherwise(0)).alias("no_match"),
        *[listed(i).alias(i.lower()) for i in ("CONFLICT", "MODIFIED", "NEW_REQUIREMENT", "ALREADY_COVERED")],
    )
    # Fixed memo text.
    memo = F.format_string(
        "Generated by the deterministic demo provider (rule-based, not a language model).\n\n"
        "Summary: %d finding(s) for %s: %d whose quotations were found in their sources, "
        "%d with no clause to compare.\n\n"
        "What needs to change — conflicts: %s; modifications: %s.\n"
        "Gaps — new requirements against: %s; obligations with no matching clause: %d.\n"
        "Already covered: %s.",
        F.col("findings"),
        F.col("circular_number"),
        F.col("located"),
        F.col("findings") - F.col("located"),
        F.col("conflict"),
        F.col("modified"),
        F.col("new_requirement"),
        F.col("no_match"),
        F.col("already_covered"),
    )
    return summed.join(numbers, "assessment_id").withColumn("memo", memo)


def apply_budget(
    calls: DataFrame,
    bucket: dict[str, Column],
    order: list,
    max_calls: int = K.MAX_ASSESSMENT_CALLS,
    max_tokens: int = K.MAX_ASSESSMENT_TOKENS,
) -> DataFrame:
    """(run_id, tokens, …) in call order → what was spent before each call and whether it is refused.

    Both limits only ever grow towards exhaustion, so each call is decided by the calls and
    tokens before it; the call that crosses the token limit still completes.
    """
    run = running_totals(
        calls, ["run_id"], bucket, order, {"__n": F.lit(1).cast("long"), "__t": F.col("tokens")}
    )
    before = run.withColumns(
        {"calls_before": F.col("__n") - 1, "tokens_before": F.col("__t") - F.col("tokens")}
    ).drop("__n", "__t")
    return before.withColumn(
        "refused", (F.col("calls_before") >= max_calls) | (F.col("tokens_before") >= max_tokens)
    )


def budget_totals(
    decided: DataFrame, max_calls: int = K.MAX_ASSESSMENT_CALLS, max_tokens: int = K.MAX_ASSESSMENT_TOKENS
) -> DataFrame:
    """Per run: calls and tokens spent and the reason it stopped, null when it did not."""
    kept = ~F.col("refused")
    first = F.min(F.when(F.col("refused"), F.struct("calls_before", "tokens_before")))
    summed = decided.groupBy("run_id").agg(
        F.count_if(kept).alias("calls"),
        F.coalesce(F.sum(F.when(kept, F.col("tokens"))), F.lit(0)).alias("tokens"),
        first.alias("__stop"),
    )
    reason = F.when(
        F.col("__stop.calls_before") >= max_calls,
        F.format_string(
            f"Call budget reached: %d of {max_calls} provider calls.", F.col("__stop.calls_before")
        ),
    ).when(
        F.col("__stop").isNotNull(),
        F.format_string(f"Token budget reached: %d of {max_tokens} tokens.", F.col("__stop.tokens_before")),
    )
    return summed.withColumn("exhausted_reason", reason).drop("__stop")


def run_outcome(runs: DataFrame, timeout_seconds: int = K.ASSESSMENT_TIMEOUT_SECONDS) -> DataFrame:
    """(…, seconds, error, exhausted_reason, obligations, memo) → status, detail and the memo kept."""
    late = F.col("seconds") > timeout_seconds
    failed = F.col("error").isNotNull()
    spent = F.col("exhausted_reason").isNotNull()
    empty = F.col("obligations") == 0
    status = F.when(late, "CAPPED").when(failed, "FAILED").when(spent, "CAPPED").otherwise("COMPLETED")
    # Fixed message texts.
    detail = (
        F.when(
            late,
            f"Stopped at the {timeout_seconds}s wall-clock limit. Findings recorded before then "
            "are kept; the memo was not written.",
        )
        .when(failed, F.col("error"))
        .when(
            spent,
            F.concat(
                "exhausted_reason",
                F.lit(" Findings recorded before the limit are kept; the memo was not written."),
            ),
        )
        .when(empty, "This circular has no extracted obligations, so there was nothing to assess.")
        .when(F.col("memo").isNull(), "No finding had its quotes located, so no memo was written.")
    )
    keeps = (status == "COMPLETED") & ~empty
    return runs.withColumns(
        {"status": status, "detail": detail, "memo": F.when(keeps, F.col("memo"))}
    )
