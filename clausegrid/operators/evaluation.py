"""Measuring retrieval, refusal, extraction, groundedness, agreement, latency and cost."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions import fixed as K
from clausegrid.functions import text as T
from clausegrid.functions.ranking import top_n
from clausegrid.functions.scan import left_join_spread, running_totals
from clausegrid.session import cut_lineage


def query_outcomes(rows: DataFrame, cutoff: int = K.RANKING_CUTOFF) -> DataFrame:
    """(query_id, mode, subset, relevant, retrieved) → position of the first relevant document and hits."""
    places = F.filter(
        F.transform(
            F.slice("retrieved", 1, cutoff),
            lambda d, i: F.when(F.array_contains(F.col("relevant"), d), i + 1),
        ),
        lambda p: p.isNotNull(),
    )
    rank = F.coalesce(F.array_min(places), F.lit(None))
    hit = lambda k: F.when(F.col("rank") <= k, 1.0).otherwise(0.0)
    return (
        rows.withColumn("rank", rank)
        .withColumns({"hit_1": hit(1), "hit_5": hit(5), "hit_10": hit(10)})
        .withColumn("reciprocal_rank", F.coalesce(1.0 / F.col("rank"), F.lit(0.0)))
    )


def ranking_metrics(outcomes: DataFrame, by_subset: bool = True) -> DataFrame:
    """Recall at 1, 5 and 10 and MRR at 10 per mode, over all in-scope queries and per subset."""
    ranked = outcomes.where(F.col("subset").isin(*K.RANKED_SUBSETS))
    means = [
        F.count("*").alias("n"),
        F.avg("hit_1").alias("recall_1"),
        F.avg("hit_5").alias("recall_5"),
        F.avg("hit_10").alias("recall_10"),
        F.avg("reciprocal_rank").alias("mrr_10"),
    ]
    if not by_subset:
        return ranked.groupBy("mode").agg(*means).withColumn("subset", F.lit("all"))
    sets = ranked.groupingSets([["mode", "subset"], ["mode"]], "mode", "subset").agg(*means)
    return sets.withColumn("subset", F.coalesce("subset", F.lit("all")))


def refusal_rule(outcomes: DataFrame, threshold: float = K.RELEVANCE_THRESHOLD) -> DataFrame:
    """Only the reranked mode refuses: without a score or below the threshold; others are null."""
    score = F.col("top_score")
    return outcomes.withColumn(
        "refused", F.when(F.col("mode") == "hybrid_rerank", score.isNull() | (score < threshold))
    )


def refusal_metrics(outcomes: DataFrame) -> DataFrame:
    """Per mode: refusal of in-scope, out-of-scope and control queries, and recall counting refusals as misses."""
    ranked = F.col("subset").isin(*K.RANKED_SUBSETS)
    out, control = F.col("subset") == "out_of_scope", F.col("subset") == "control"
    refused = F.coalesce("refused", F.lit(False))

    def rate(group: Column) -> Column:
        return F.coalesce(F.avg(F.when(group, F.when(refused, 1.0).otherwise(0.0))), F.lit(0.0))

    wide = outcomes.groupBy("mode").agg(
        F.count_if(ranked).alias("n_in_scope"),
        F.count_if(out).alias("n_out_of_scope"),
        F.count_if(control).alias("n_control"),
        rate(ranked).alias("refused_in_scope"),
        rate(out).alias("refused_out_of_scope"),
        rate(control).alias("refused_control"),
        F.avg(F.when(ranked, F.when(refused, 0.0).otherwise(F.col("hit_10")))).alias("answered_recall_10"),
        F.count_if(out & refused).alias("__out"),
        (F.count_if(ranked & F.col("refused").isNotNull()) == 0).alias("never_refuses"),
    )
    interval = T.wilson_interval(F.col("__out").cast("double"), F.col("n_out_of_scope").cast("double"))
    return wide.withColumns(
        {
            "out_of_scope_low": F.when(~F.col("never_refuses"), interval["low"]),
            "out_of_scope_high": F.when(~F.col("never_refuses"), interval["high"]),
            "answered_recall_10": F.when(~F.col("never_refuses"), F.col("answered_recall_10")),
        }
    ).drop("__out")


def refusal_accuracy(cases: DataFrame) -> DataFrame:
    """(should_refuse, refused) → rates of correct and false refusals and the share decided rightly."""
    wanted = F.col("should_refuse")
    summed = cases.agg(
        F.count_if(wanted).alias("n_should_refuse"),
        F.count_if(~wanted).alias("n_should_answer"),
        F.coalesce(F.avg(F.when(wanted, F.col("refused").cast("double"))), F.lit(0.0)).alias("correct_refusal_rate"),
        F.coalesce(F.avg(F.when(~wanted, F.col("refused").cast("double"))), F.lit(0.0)).alias("false_refusal_rate"),
        F.count_if(wanted == F.col("refused")).alias("__right"),
        F.count("*").alias("__n"),
    )
    overall = F.when(F.col("__n") > 0, F.col("__right") / F.col("__n")).otherwise(0.0)
    return summed.withColumn("overall_accuracy", overall).drop("__right", "__n")


def wrong_refusals(cases: DataFrame) -> DataFrame:
    kind = F.when(F.col("should_refuse"), "missed refusal").otherwise("false refusal")
    return cases.where(F.col("should_refuse") != F.col("refused")).withColumn("kind", kind)


def exact_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles per key without gathering a key's values in one task.

    Equal values are counted first; the counts are accumulated in value order range by range,
    and the two order statistics around each position are read off the running count.
    """
    v = F.col(value)
    counts = df.where(v.isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    scale = F.signum(v) * F.floor(F.log2(F.abs(v) + 1) * 64)
    through = running_totals(counts, keys, {"range": scale}, [value], {"__through": F.col("__c")})
    totals = counts.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    joined = through.join(totals, keys)
    aggregates = []
    for name, q in shares.items():
        place = (F.col("__n") - 1) * q
        for side, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            aggregates.append(F.min(F.when(F.col("__through") > at, v)).alias(f"__{side}_{name}"))
    found = joined.groupBy(*keys, "__n").agg(*aggregates)
    out = []
    for name, q in shares.items():
        place = (F.col("__n") - 1) * q
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        out.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return found.select(*keys, F.col("__n").alias("n"), *out)


def latency_metrics(outcomes: DataFrame) -> DataFrame:
    """Median, 95th percentile and mean latency per mode."""
    points = exact_percentiles(outcomes, ["mode"], "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95})
    means = outcomes.groupBy("mode").agg(F.avg("latency_ms").alias("mean_ms"))
    return points.join(means, "mode")


DRAW_PRIME = 2**31 - 1
# Where a uniform number below the prime passes 1, 2, ... events of a Poisson distribution of mean 1.
POISSON_STEPS = [
    math.floor(DRAW_PRIME * math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1))) for k in range(9)
]


#: Hex digits of a cluster's MD5 in each of the numbers that steer its draws; together they are the whole hash.
HASH_PARTS = ((1, 7), (8, 7), (15, 7), (22, 7), (29, 4))
#: Clusters drawn together in a task, and keys whose sums a task holds before it hands them on.
DRAWN_TOGETHER, KEYS_HELD = 256, 64


def cluster_numbers(cluster: Column) -> Column:
    """The MD5 of a cluster's name as an array of numbers below 2**28."""
    digest = F.md5(cluster)
    return F.array(*(F.conv(F.substring(digest, start, size), 16, 10).cast("long") for start, size in HASH_PARTS))


def poisson_weights(numbers: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """How often each resample takes each cluster: Poisson(1), a row for each cluster.

    The resample's number goes through one round for each part of the cluster's hash: the part is added and the
    fifth power taken modulo a prime, which permutes the residues. Two clusters draw alike only if their
    whole hashes agree, and any engine with whole numbers can repeat the draws.
    """
    x = np.arange(resamples, dtype=np.int64)[None, :] * 268435459 + seed
    for part in numbers.T:
        x = (x + part[:, None]) % DRAW_PRIME
        square = x * x % DRAW_PRIME
        x = square * square % DRAW_PRIME * x % DRAW_PRIME
    return np.searchsorted(np.array(POISSON_STEPS), x, "right").astype("float64")


def _resampled(sums: DataFrame, keys: list[str], metrics: list[str], resamples: int, seed: int) -> DataFrame:
    """keys, __b, __k clusters, __n rows and the metrics' sums taken by resample __b, as each task sees them."""
    own = sums.select(*keys, "__numbers", "__n", *(F.col(f"__s_{m}").cast("double").alias(m) for m in metrics))
    names = ["__n", *metrics]
    schema = own.select(*keys, F.lit(0).alias("__b"), F.lit(0).cast("long").alias("__k"), *(F.lit(0.0).alias(c) for c in names)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for key, (k, seen, total) in held.items():
                columns = [pa.array([v] * resamples, f.type) for v, f in zip(key, arrow)]
                values = [pa.array(t, pa.float64()) if there else pa.nulls(resamples, pa.float64()) for t, there in zip(total, seen)]
                columns += [pa.array(range(resamples), pa.int32()), pa.array([k] * resamples, pa.int64()), *values]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)
            held.clear()

        for batch in batches:
            arrow = [batch.schema.field(c) for c in keys]
            found = list(zip(*(batch.column(c).to_pylist() for c in keys)))
            numbers = batch.column("__numbers").flatten().to_numpy().reshape(-1, len(HASH_PARTS))
            values = np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in names], 1)
            rows: dict[tuple, list[int]] = {}
            for i, key in enumerate(found):
                rows.setdefault(key, []).append(i)
            for key, mine in rows.items():
                for at in range(0, len(mine), DRAWN_TOGETHER):
                    some = mine[at : at + DRAWN_TOGETHER]
                    part = values[some]
                    drawn = np.nan_to_num(part).T @ poisson_weights(numbers[some], resamples, seed)
                    k, seen, total = held.get(key, (0, np.zeros(len(names), bool), 0.0))
                    held[key] = (k + len(some), seen | ~np.isnan(part).all(0), total + drawn)
                if len(held) >= KEYS_HELD:
                    yield from handed()
        if held:
            yield from handed()

    return own.mapInArrow(run, schema)


def cluster_bootstrap(
    rows: DataFrame,
    keys: list[str],
    metrics: list[str],
    resamples: int = K.BOOTSTRAP_RESAMPLES,
    seed: int = K.BOOTSTRAP_SEED,
    level: float = 0.95,
) -> DataFrame:
    """Percentile intervals of means under resampling of whole clusters, per key.

    Rows shrink to sums per cluster. Each resample takes a cluster a Poisson-distributed number of
    times, which needs no join, numbering or size of the whole; blocks of clusters times resamples are one
    product in the task that holds them, and one row per key, resample and task travels. Fewer than five
    clusters give no interval. The bounds are order statistics of the resamples.
    """
    sums = rows.groupBy(*keys, "cluster").agg(
        F.count("*").alias("__n"), *[F.sum(m).alias(f"__s_{m}") for m in metrics]
    )
    drawn = _resampled(sums.withColumn("__numbers", cluster_numbers(F.col("cluster"))), keys, metrics, resamples, seed)
    means = (
        drawn.groupBy(*keys, "__b")
        .agg(F.sum("__k").alias("__k"), *[F.try_divide(F.sum(m), F.sum("__n")).alias(m) for m in metrics])
        .where(F.col("__k") >= K.BOOTSTRAP_MIN_CLUSTERS)
    )
    tail = (1 - level) / 2
    low, high = math.floor(tail * (resamples - 1)), math.ceil((1 - tail) * (resamples - 1))
    ordered = lambda m: F.array_sort(F.collect_list(m))  # noqa: E731  one value per resample
    return means.groupBy(*keys).agg(
        *[
            c
            for m in metrics
            for c in (F.get(ordered(m), F.lit(low)).alias(f"{m}_low"), F.get(ordered(m), F.lit(high)).alias(f"{m}_high"))
        ]
    )


def paired_differences(
    outcomes: DataFrame,
    comparisons: tuple[tuple[str, str], ...] = K.MODE_COMPARISONS,
    resamples: int = K.BOOTSTRAP_RESAMPLES,
) -> DataFrame:
    """Mean difference of two modes on identical queries, with an interval over clusters.

    A query's modes meet in one aggregation instead of a self join.
    """
    ranked = outcomes.where(F.col("subset").isin(*K.RANKED_SUBSETS))
    named = sorted({m for pair in comparisons for m in pair})
    per_query = ranked.groupBy("query_id", "cluster").agg(
        *[F.max(F.when(F.col("mode") == m, F.struct("hit_10", "reciprocal_rank"))).alias(m) for m in named]
    )
    rows = per_query.select(
        "cluster",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(a).alias("a"),
                        F.lit(b).alias("b"),
                        (F.col(a)["hit_10"] - F.col(b)["hit_10"]).alias("recall_10"),
                        (F.col(a)["reciprocal_rank"] - F.col(b)["reciprocal_rank"]).alias("mrr_10"),
                    )
                    for a, b in comparisons
                ]
            )
        ),
    ).where("recall_10 IS NOT NULL")
    means = rows.groupBy("a", "b").agg(
        F.count("*").alias("n"),
        F.avg("recall_10").alias("recall_10_difference"),
        F.avg("mrr_10").alias("mrr_10_difference"),
    )
    intervals = cluster_bootstrap(rows, ["a", "b"], ["recall_10", "mrr_10"], resamples)
    return means.join(intervals, ["a", "b"], "left")


def miss_examples(outcomes: DataFrame, n: int = 6) -> DataFrame:
    """The first misses per mode by query id, with the three best documents they got instead."""
    missed = outcomes.where(F.col("subset").isin(*K.RANKED_SUBSETS) & F.col("rank").isNull())
    kept = top_n(missed.drop("rank"), ["mode"], [F.col("query_id").asc()], n, "place")
    return kept.select(
        "mode", "query_id", "subset", "relevant", F.slice("retrieved", 1, 3).alias("top3")
    )


# --- extraction ---------------------------------------------------------------------------


def match_extractions(predicted: DataFrame, labelled: DataFrame) -> DataFrame:
    """One-to-one matches (pred_id, label_id): predictions in order take their first free label.

    Inputs: id, circular_id, actor, char_start, char_end; order is (char_start, char_end, id).
    A pair can match when the spans overlap and one actor holds the other. In each round every
    pair that is first for both of its ends is settled, which is what taking turns would do;
    rounds go on while pairs are left, usually one. Spans meet by ranges of positions.
    """
    order = lambda p: F.struct(*[F.col(f"{p}_{c}") for c in ("start", "end", "id")])
    p = _ranged(predicted, "pred")
    g = _ranged(labelled, "label")
    first = F.greatest(F.floor(F.col("pred_start") / 1024), F.floor(F.col("label_start") / 1024))
    open_ = (
        p.join(g, ["circular_id", "range"])
        .where(
            (F.col("range") == first)
            & (F.col("pred_start") < F.col("label_end"))
            & (F.col("label_start") < F.col("pred_end"))
            & T.names_agree(F.col("pred_actor"), F.col("label_actor"))
        )
        .select(order("pred").alias("p"), order("label").alias("g"))
    )
    # The pairs are read twice in a round: which are settled, and which are left.
    open_ = cut_lineage(open_)
    settled = None
    while True:
        best_label = open_.groupBy("p").agg(F.min("g").alias("g"))
        best_pred = open_.groupBy("g").agg(F.min("p").alias("p"))
        agreed = cut_lineage(best_label.join(best_pred, ["p", "g"]))
        settled = agreed if settled is None else settled.unionByName(agreed)
        open_ = cut_lineage(
            open_.join(agreed.select("p"), "p", "left_anti").join(agreed.select("g"), "g", "left_anti")
        )
        if open_.isEmpty():
            return settled.select(F.col("p.pred_id").alias("pred_id"), F.col("g.label_id").alias("label_id"))


def _ranged(rows: DataFrame, name: str) -> DataFrame:
    start, end = F.col("char_start"), F.col("char_end")
    return rows.select(
        "circular_id",
        F.col("id").alias(f"{name}_id"),
        T.normalise_actor(F.col("actor")).alias(f"{name}_actor"),
        start.alias(f"{name}_start"),
        end.alias(f"{name}_end"),
        F.explode(F.sequence(F.floor(start / 1024), F.floor((end - 1) / 1024))).alias("range"),
    )


def extraction_prf(predicted: DataFrame, labelled: DataFrame, matches: DataFrame) -> DataFrame:
    """Precision, recall and F1 of one-to-one matches; 0 where a denominator is 0."""
    one = F.lit(1).alias("__one")
    counts = (
        matches.agg(F.count("*").alias("tp"))
        .select("*", one)
        .join(predicted.agg(F.count("*").alias("n_predicted")).select("*", one), "__one")
        .join(
            labelled.agg(
                F.count("*").alias("n_labelled"), F.countDistinct("circular_id").alias("n_circulars")
            ).select("*", one),
            "__one",
        )
    )
    tp, p, g = F.col("tp"), F.col("n_predicted"), F.col("n_labelled")
    return counts.select(
        tp.alias("true_positives"),
        (p - tp).alias("false_positives"),
        (g - tp).alias("false_negatives"),
        "n_labelled",
        "n_predicted",
        "n_circulars",
        F.when(p > 0, tp / p).otherwise(0.0).alias("precision"),
        F.when(g > 0, tp / g).otherwise(0.0).alias("recall"),
        F.when((tp > 0), 2 * tp / (p + g)).otherwise(0.0).alias("f1"),
    )


def unmatched_labels(labelled: DataFrame, matches: DataFrame, n: int = 20) -> DataFrame:
    lost = labelled.join(matches.select(F.col("label_id").alias("id")), "id", "left_anti")
    return (
        lost.orderBy("circular_id", "char_start", "char_end").limit(n).select("circular_id", "char_start", "actor")
    )


# --- groundedness, agreement ----------------------------------------------------------------


def groundedness_layer1(
    findings: DataFrame, obligations: DataFrame, paragraphs: DataFrame, clauses: DataFrame
) -> DataFrame:
    """One row per finding: do its spans resolve, and does its quote lie in its obligation.

    Slices of the circular come from the paragraphs the span meets, so full texts never move.
    """
    from clausegrid.operators.views import meeting_paragraphs

    o = obligations.select(
        F.col("id").alias("obligation_id"), "circular_id", F.col("text").alias("__obligation")
    )
    c = clauses.select(
        F.col("id").alias("policy_clause_id"), F.col("text").alias("__clause"), F.col("char_start").alias("__base")
    )
    rows = findings.select(
        "id",
        "obligation_id",
        "policy_clause_id",
        "circular_span_start",
        "circular_span_end",
        "clause_span_start",
        "clause_span_end",
    )
    rows = left_join_spread(rows.join(o, "obligation_id", "left"), c, "policy_clause_id")
    spans = rows.where("circular_span_start IS NOT NULL").select(
        F.col("id").alias("span_id"),
        "circular_id",
        F.col("circular_span_start").alias("start"),
        F.col("circular_span_end").alias("end"),
    )
    met = meeting_paragraphs(spans, paragraphs).join(
        paragraphs.select("circular_id", "order_index", F.col("text").alias("__p")), ["circular_id", "order_index"]
    )
    piece = T.sliced(
        F.col("__p"), (F.col("start") - F.col("p_start")).cast("int"), (F.col("end") - F.col("p_start")).cast("int")
    )
    slices = met.groupBy(F.col("span_id").alias("id")).agg(
        F.array_join(
            F.array_sort(F.collect_list(F.struct("order_index", piece.alias("piece"))))["piece"], K.PARAGRAPH_SEPARATOR
        ).alias("__slice")
    )
    joined = rows.join(slices, "id", "left")
    asked, clause_asked = F.col("circular_span_start").isNotNull(), F.col("clause_span_start").isNotNull()
    text = F.coalesce("__slice", F.lit(""))
    local = T.sliced(
        F.col("__clause"),
        (F.col("clause_span_start") - F.col("__base")).cast("int"),
        (F.col("clause_span_end") - F.col("__base")).cast("int"),
    )
    circular_ok = ~asked | F.col("circular_id").isNull() | (T.strip(text) != "")
    clause_ok = ~clause_asked | F.col("__clause").isNull() | (T.strip(local) != "")
    inside = ~asked | F.col("__obligation").isNull() | T.resolve_quote(text, F.col("__obligation")).isNotNull()
    return joined.select(
        "id",
        circular_ok.alias("circular_span_resolves"),
        clause_ok.alias("clause_span_resolves"),
        inside.alias("span_in_context"),
        (circular_ok & clause_ok & inside).alias("grounded"),
    )


def groundedness_totals(checked: DataFrame) -> DataFrame:
    """Counts by kind of failure; the rate is null, not 0, when there is no finding."""
    return checked.agg(
        F.count("*").alias("n_findings"),
        F.count_if("grounded").alias("n_grounded"),
        F.count_if(~F.col("circular_span_resolves")).alias("unresolved_circular_spans"),
        F.count_if(~F.col("clause_span_resolves")).alias("unresolved_clause_spans"),
        F.count_if(~F.col("span_in_context")).alias("spans_outside_context"),
        F.avg(F.col("grounded").cast("double")).alias("grounded_rate"),
    )


def cohens_kappa(pairs: DataFrame) -> DataFrame:
    """(judge_supported, human_supported) → agreement beyond chance, with why it is undefined."""
    both = pairs.where(F.col("human_supported").isNotNull())
    rate = lambda c: F.avg(c.cast("double"))
    judge, human = F.col("judge_supported"), F.col("human_supported")
    summed = both.agg(
        F.count("*").alias("n_compared"),
        rate(judge == human).alias("raw_agreement"),
        rate(judge).alias("judge_positive_rate"),
        rate(human).alias("human_positive_rate"),
    )
    j, h = F.col("judge_positive_rate"), F.col("human_positive_rate")
    chance = j * h + (1 - j) * (1 - h)
    k = F.col("cohens_kappa")
    # Fixed message texts and bands.
    reason = F.when(F.col("n_compared") == 0, "no pairs to compare").when(
        chance >= 1.0, "both raters gave every pair the same label, so chance agreement is 1"
    )
    band = (
        F.when(k.isNull(), F.concat(F.lit("undefined: "), "kappa_undefined"))
        .when(k < 0.0, "worse than chance")
        .when(k < 0.20, "slight")
        .when(k < 0.40, "fair")
        .when(k < 0.60, "moderate")
        .when(k < 0.80, "substantial")
        .otherwise("almost perfect")
    )
    kappa = F.when(chance < 1.0, (F.col("raw_agreement") - chance) / (1 - chance))
    return summed.withColumns({"cohens_kappa": kappa, "kappa_undefined": reason}).withColumn(
        "interpretation", band
    )


# --- latency and cost ------------------------------------------------------------------------


def node_breakdown(steps: DataFrame) -> DataFrame:
    """Calls, latency, tokens and cost per node; a cost is unknown once one step has no price.

    Reading order is total_ms descending.
    """
    points = exact_percentiles(steps, ["node"], "latency_ms", {"p50_ms": 0.5, "p95_ms": 0.95}).drop("n")
    summed = steps.groupBy("node").agg(
        F.count("*").alias("calls"),
        F.sum("latency_ms").alias("total_ms"),
        F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("total_tokens"),
        F.when(F.count_if(F.col("cost_usd").isNull()) == 0, F.sum("cost_usd")).alias("total_cost_usd"),
    )
    return summed.join(points, "node")


def run_stats(steps: DataFrame) -> DataFrame:
    """Over all runs: latency percentiles of the wall time, mean tokens and mean cost."""
    runs = steps.groupBy("run_id").agg(
        (F.unix_micros(F.max("started_at")) - F.unix_micros(F.min("started_at"))).alias("__us"),
        F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens"),
        F.sum("cost_usd").alias("cost"),
    )
    timed = runs.select("tokens", "cost", (F.col("__us") / 1000.0).alias("latency_ms"), F.lit(1).alias("__one"))
    points = exact_percentiles(timed, ["__one"], "latency_ms", {"p50_latency_ms": 0.5, "p95_latency_ms": 0.95})
    means = timed.groupBy("__one").agg(F.avg("tokens").alias("mean_tokens"), F.avg("cost").alias("mean_cost_usd"))
    return points.join(means, "__one").drop("__one").withColumnRenamed("n", "n_assessments")


# --- comparing runs ----------------------------------------------------------------------------


def dataset_fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Content hash of a table that does not depend on row order; nothing is collected."""
    digest = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]), 256)
    # The whole hash, in four parts of 16 digits, each summed by itself.
    parts = [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)") for i in range(4)]
    summed = rows.agg(F.count("*").alias("rows"), *[F.coalesce(F.sum(p), F.lit(0)).alias(f"__t{i}") for i, p in enumerate(parts)])
    totals = [F.col(f"__t{i}").cast("decimal(38,0)").cast("string") for i in range(4)]
    text = F.concat_ws(":", F.col("rows").cast("string"), *totals)
    return summed.select("rows", F.sha2(text, 256).alias("fingerprint"))


def regression_gate(measured: DataFrame, baseline: DataFrame, tolerance: float = K.GATE_TOLERANCE) -> DataFrame:
    """(metric, value, fingerprint) against a baseline; other data is refused, not compared."""
    b = baseline.select(
        "metric", F.col("value").alias("baseline"), F.col("fingerprint").alias("__expected")
    )
    same = F.coalesce(F.col("fingerprint") == F.col("__expected"), F.lit(False))
    verdict = (
        F.when(~same, "refused: different data")
        .when(F.col("value") >= F.col("baseline") - tolerance, "ok")
        .otherwise("REGRESSED")
    )
    return measured.join(b, "metric", "left").select("metric", "value", "baseline", verdict.alias("verdict"))


def variant_bench(rows: DataFrame, reference: str) -> DataFrame:
    """Per variant: latency, hits, and how far its rankings are those of the reference variant.

    Rows: variant, query_id, latency_ms, hit, retrieved, top_score.
    """
    base = rows.where(F.col("variant") == reference).select(
        "query_id", F.col("retrieved").alias("__r"), F.col("top_score").alias("__s")
    )
    joined = rows.join(base, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    summed = joined.groupBy("variant").agg(
        F.count("*").alias("n"),
        F.min("latency_ms").alias("min_ms"),
        F.max("latency_ms").alias("max_ms"),
        F.count_if("hit").alias("hits_at_10"),
        F.count_if(F.col("retrieved") == F.col("__r")).alias("same_top10"),
        F.max(F.abs(zero("top_score") - zero("__s"))).alias("max_score_difference"),
    )
    median = exact_percentiles(rows, ["variant"], "latency_ms", {"median_ms": 0.5}).drop("n")
    return summed.join(median, "variant")


def ablation_table(metrics: DataFrame, names: list[str]) -> DataFrame:
    """(mode, metric_name, metric_value) → one row per mode, one column per metric."""
    return metrics.groupBy("mode").pivot("metric_name", names).agg(F.max("metric_value"))


def resummarise(outcomes: DataFrame, subsets: DataFrame) -> DataFrame:
    """Ranking metrics again from stored outcomes, under corrected subsets (query_id, subset)."""
    fixed = outcomes.drop("subset").join(subsets, "query_id")
    return ranking_metrics(fixed)
