"""Mixing sources to target weights by hash-random order and distributed prefix sums of sizes."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from clausegrid.llm.common import count_words, join_small, ranked, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: Leading hex digits of the random key that number its ranges: 4,096 of them in each source.
RANGE_DIGITS = 3


def random_key(doc_id: Column, seed: str = "mix") -> Column:
    """A hash of seed and id; the same in every run. A null id counts as empty."""
    return F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP
) -> tuple[DataFrame, int]:
    """``source, source_size, target`` per source, and how many sources there are.

    Sources in code-point order, null last, get the weights in turn. The targets add up to ``share``
    of all sizes; none exceeds ``cap`` times its source's size, and what lies above is shared again
    by weight among the rest until none is above. Only sums reach the driver.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    turn = F.col("turn") % len(weights)
    weight = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        weight = F.when(turn == i, F.lit(float(w))).otherwise(weight)
    sources = stored(ranked(totals, order, "turn").withColumn("weight", weight), "sources")
    limit = F.col("source_size") * F.lit(cap)
    first = sources.agg(
        F.sum("source_size").alias("all"), F.sum("weight").alias("weights"), F.count("*").alias("n")
    ).first()
    wanted = float(first["all"] or 0) * share
    left, among, capped_before = wanted, float(first["weights"] or 0), 0
    while among > 0:
        above = F.col("weight") * F.lit(left) / F.lit(among) > limit
        now = sources.agg(
            F.sum(above.cast("long")).alias("n"),
            F.sum(F.when(above, limit)).alias("held"),
            F.sum(F.when(~above, F.col("weight"))).alias("weights"),
        ).first()
        if now["n"] == capped_before:
            break
        capped_before = now["n"]
        left, among = wanted - float(now["held"] or 0), float(now["weights"] or 0)
    even = F.col("weight") * F.lit(left) / F.lit(among) if among > 0 else limit
    target = F.when(even > limit, limit).otherwise(even).alias("target")
    return sources.select("source", "source_size", target), first["n"]


def _epochs(targets: DataFrame) -> DataFrame:
    """Adds ``epochs`` (whole passes over the source) and ``rest`` (words of the last pass)."""
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    return targets.withColumn("epochs", epochs.cast("long")).withColumn(
        "rest", (budget - F.col("epochs") * F.col("source_size")).cast("long")
    )


def _range_starts(sized: DataFrame) -> DataFrame:
    """Words of a source before each of its key ranges: one row for each source and range."""
    before = (
        W.Window.partitionBy("source").orderBy("range").rowsBetween(W.Window.unboundedPreceding, -1)
    )
    return (
        sized.groupBy("source", "range")
        .agg(F.sum("size").alias("in_range"))
        .withColumn("start", F.coalesce(F.sum("in_range").over(before), F.lit(0)))
    )


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    key = random_key(F.col("doc_id"), seed)
    rows = docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), key.alias("key"))
    return stored(rows.withColumn("range", F.substring("key", 1, RANGE_DIGITS)), "mix")


def mix(docs: DataFrame, seed: str = "mix", **rules) -> DataFrame:
    """How many words of every document the mix takes.

    ``docs``: doc_id, source, text; other columns are not read. One row per row of ``docs``:
    ``doc_id, size, source_size, target, taken, source, copies``. Documents of a source stand in the
    order of a hash of their ids. The mix reads a source from its start as often as its target says
    and stops after exactly ``floor(target)`` words; the document it stops in counts with the words
    up to there, and as one more whole copy in ``copies``.

    Null text: size 0. Null source: a source of its own, after the others. Null or repeated ids:
    rows of equal id share their place in the order and are taken one after the other. No rows: none.
    """
    sized = _sized(docs, seed)
    targets, n_sources = source_targets(sized, **rules)
    inside = (
        W.Window.partitionBy("source", "range")
        .orderBy("key", "doc_id", "size")
        .rowsBetween(W.Window.unboundedPreceding, -1)
    )
    starts = _range_starts(sized).select(
        F.col("source").alias("of"), F.col("range").alias("in"), "start"
    )
    placed = (
        sized.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(starts, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in")))
        .withColumn("before", F.col("start") + F.col("inside"))
    )
    params = _epochs(targets).withColumnRenamed("source", "of_source")
    taken_last = F.least("size", F.greatest(F.lit(0), F.col("rest") - F.col("before")))
    return join_small(
        placed, params, F.col("source").eqNullSafe(F.col("of_source")), "inner", n_sources
    ).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + taken_last).cast("long").alias("taken"),
        "source",
        (F.col("epochs") + (F.col("before") < F.col("rest")).cast("long")).alias("copies"),
    )


def mixed_documents(docs: DataFrame, seed: str = "mix", **rules) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; whole documents only.

    All columns are kept as they are. Texts are not moved: the cut of each source is one key, and
    every row is compared with it in place. Documents up to and including the one in which the mix
    stops get one more copy. Nulls, ties and empty input as in ``mix``: rows of equal id stand or
    fall together here.
    """
    sized = _sized(docs, seed)
    targets, n_sources = source_targets(sized, **rules)
    params = stored(_epochs(targets), "targets")
    starts = _range_starts(sized)
    last = params.withColumnRenamed("source", "of").select("of", "rest")
    # The range of each source in which the mix stops, and in it the document.
    stops = join_small(starts, last, F.col("source").eqNullSafe(F.col("of")), "inner", n_sources).where(
        (F.col("start") < F.col("rest")) & (F.col("rest") <= F.col("start") + F.col("in_range"))
    )
    stops = stops.select("of", F.col("range").alias("in"), "start", "rest")
    inside = (
        W.Window.partitionBy("source", "range")
        .orderBy("key", "doc_id", "size")
        .rowsBetween(W.Window.unboundedPreceding, -1)
    )
    cut = (
        join_small(
            sized, stops, F.col("source").eqNullSafe(F.col("of")) & (F.col("range") == F.col("in")), "inner", n_sources
        )
        .withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .where(F.col("before") < F.col("rest"))
        .groupBy("source")
        .agg(F.max("key").alias("cut"))
        .select(F.col("source").alias("of"), "cut")
    )
    plan = stored(
        params.join(cut, F.col("source").eqNullSafe(F.col("of")), "left").select(
            F.struct(F.col("source").alias("source"), "epochs", "cut").alias("__plan")
        ),
        "plan",
    )
    key = random_key(F.col("doc_id"), seed)
    rows = docs.select(F.struct(*docs.columns).alias("__row"), "source", key.alias("__key"))
    copies = F.col("__plan.epochs") + F.coalesce(F.col("__key") <= F.col("__plan.cut"), F.lit(False)).cast("long")
    return (
        join_small(rows, plan, F.col("source").eqNullSafe(F.col("__plan.source")), "inner", n_sources)
        .where(copies > 0)
        .withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
        .select("__row.*")
    )



SQL = """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
           WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM totals),
-- Sources reach their cap in the order of size by weight: with the first k of them capped, the level
-- of the rest is the water level; the right k is the first at which the next one stays below.
ranked AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM weighed),
levels AS (
  SELECT *, (SELECT 1.5::DOUBLE * sum(source_size) FROM weighed)
              - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS among
  FROM ranked),
level AS (SELECT left_over, among FROM levels WHERE weight * left_over / among <= cap ORDER BY k LIMIT 1),
targets AS (
  SELECT source, source_size,
         coalesce(CASE WHEN weight * left_over / among > cap THEN cap ELSE weight * left_over / among END, cap) AS target
  FROM ranked LEFT JOIN level ON true),
placed AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM sized),
cut AS (
  SELECT p.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN CAST(floor(floor(t.target) / t.source_size) AS BIGINT) ELSE 0 END AS epochs
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + least(size, greatest(0, CAST(floor(target) AS BIGINT) - epochs * source_size - before)) AS BIGINT) AS taken,
       source,
       CAST(epochs + CASE WHEN before < floor(target) - epochs * source_size THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM cut
"""
