"""Quality rules: exact text statistics, base thresholds, and robust multivariate outliers.

The outlier rule takes the minimum-covariance-determinant estimate of transformed statistics of
each language and source, by concentration steps, and rejects texts whose Mahalanobis distance from
it is too large. Everything is DataFrame functions; statistics are held as whole numbers (1,024ths),
so sums are exact and a rerun gives the same verdicts whatever the partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from clausegrid.llm.common import WORD_CLASS, join_small, let, stored, words_of

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


def _repeat_words(words: Column) -> Column:
    """Words lying in a 3-word window that the text holds at least twice.

    Windows are compared by 64-bit hash: sorted with their places, equal ones stand side by side.
    """
    window = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    hashed = F.array_sort(
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(window(i).alias("h"), i.alias("i"))
        )
    )

    def repeated(rows: Column) -> Column:
        same = lambda x, k: F.coalesce(x["h"] == F.get(rows, k)["h"], F.lit(False))
        twice = F.filter(rows, lambda x, k: same(x, k - 1) | same(x, k + 1))
        places = F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
        return F.size(F.array_distinct(F.flatten(places)))

    return F.when(F.size(words) >= 3, let(hashed, repeated)).otherwise(F.lit(0))


def text_statistics(text: Column) -> Column:
    """A struct of whole-text counts; a null text has none of anything.

    ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``, all long.
    """
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_CLASS))
    by_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    by_word = let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("repeat")))
    return F.struct(
        by_word.alias("words"),
        F.length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        by_line.alias("lines"),
    )


def with_statistics(docs: DataFrame, keep: list[Column]) -> DataFrame:
    counted = docs.select(*keep, text_statistics(F.col("text")).alias("__s"))
    kept = [c for c in counted.columns if c != "__s"]
    return counted.select(
        *kept,
        F.col("__s.words.n").cast("long").alias("n_words"),
        F.col("__s.word_chars").alias("word_chars"),
        F.col("__s.n_symbols").alias("n_symbols"),
        F.col("__s.lines.n").cast("long").alias("n_lines"),
        F.col("__s.lines.dup").cast("long").alias("n_dup_lines"),
        F.col("__s.words.repeat").cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    n = F.col("n_words")
    return (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)


#: The vector of a text, in this order, and the spread below which a group's own is not believed:
#: texts that hardly differ would otherwise reject any harmless deviation.
FLOORS = {"word_length": 0.08, "symbols": 0.5, "dup_lines": 0.15, "repeats": 0.15}
UNIT = 1024
#: Share of a group's texts that the estimate covers; the rest may be arbitrarily bad.
COVERED = 0.75
#: Texts a language and source needs for an estimate of its own; smaller ones share their language's.
MIN_GROUP = 50
#: Chance that a text of a normal group lies beyond the limit.
REJECT = 1e-5
MAX_STEPS = 20
V = list(FLOORS)
PAIRS = [(i, j) for i in range(len(V)) for j in range(i + 1)]


def _chi2_tail(x: float, degrees: int) -> float:
    """P(chi-squared > x) for an even number of degrees."""
    term = total = 1.0
    for k in range(1, degrees // 2):
        term *= x / 2 / k
        total += term
    return math.exp(-x / 2) * total


def _chi2_limit(tail: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_tail(mid, degrees) > tail else (low, mid)
    return high


def _vector() -> list[Column]:
    """Transformed statistics in 1,024ths: logs of word length and symbols, shares of repetition."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    raw = [
        F.log(chars / n),
        F.log1p(1000 * F.col("n_symbols") / chars),
        F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        F.col("n_repeat_words") / n,
    ]
    return [F.round(x * UNIT).cast("long").alias(f"v_{name}") for name, x in zip(V, raw)]


def _with_group(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds ``group``, the estimate a row is held against; and the groups with their usable rows."""
    usable = counted.where(~F.col("base_failed"))
    small = (
        usable.groupBy("own_group", "lang_group")
        .agg(F.count("*").alias("own_n"))
        .withColumn("group", F.when(F.col("own_n") >= MIN_GROUP, F.col("own_group")).otherwise(F.col("lang_group")))
    )
    small = stored(small, "groups")
    groups = small.groupBy("group").agg(F.sum("own_n").alias("n")).where(F.col("n") >= MIN_GROUP)
    return small.select("own_group", "group"), groups


def _inverse(sums: DataFrame, factor: float) -> DataFrame:
    """``group, m_*, p_*``: mean and inverse of the floored covariance, by Cholesky factors."""
    n = F.col("c")
    df = sums.select("group", "c", *[(F.col(f"s_{i}") / n).alias(f"m_{i}") for i in range(len(V))], *[f"s_{i}_{j}" for i, j in PAIRS])
    cov = {}
    for i, j in PAIRS:
        x = (F.col(f"s_{i}_{j}") / n - F.col(f"m_{i}") * F.col(f"m_{j}")) * factor
        if i == j:
            x = F.greatest(x, F.lit(0.0)) + (FLOORS[V[i]] * UNIT) ** 2
        cov[i, j] = x.alias(f"a_{i}_{j}")
    means = [f"m_{i}" for i in range(len(V))]
    df = df.select("group", *means, *cov.values())
    for j in range(len(V)):  # Cholesky, one column of the factor after the other
        square = F.col(f"a_{j}_{j}") - sum((F.col(f"l_{j}_{k}") ** 2 for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"l_{j}_{j}", F.sqrt(square))
        for i in range(j + 1, len(V)):
            rest = F.col(f"a_{i}_{j}") - sum((F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}") for k in range(j)), F.lit(0.0))
            df = df.withColumn(f"l_{i}_{j}", rest / F.col(f"l_{j}_{j}"))
    for i in range(len(V)):  # the inverse of the factor, row by row
        for j in range(i + 1):
            if i == j:
                df = df.withColumn(f"u_{i}_{i}", 1 / F.col(f"l_{i}_{i}"))
            else:
                inner = sum((F.col(f"l_{i}_{k}") * F.col(f"u_{k}_{j}") for k in range(j, i)), F.lit(0.0))
                df = df.withColumn(f"u_{i}_{j}", -inner / F.col(f"l_{i}_{i}"))
    p = [
        sum((F.col(f"u_{k}_{i}") * F.col(f"u_{k}_{j}") for k in range(i, len(V))), F.lit(0.0)).alias(f"p_{i}_{j}")
        for i, j in PAIRS
    ]
    return df.select("group", *means, *p)


def _distance() -> Column:
    d = [F.col(f"v_{name}") - F.col(f"m_{i}") for i, name in enumerate(V)]
    return sum(((1 if i == j else 2) * F.col(f"p_{i}_{j}") * d[i] * d[j] for i, j in PAIRS), F.lit(0.0))


def _covered_sums(near: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """Counts and sums of the nearest rows of each group, at least ``COVERED`` of them.

    Squared distances fall into bins of 1/64 of a doubling. A group's bins (some hundreds at most)
    are taken from the nearest on until they hold enough rows, the last one whole.
    """
    v = [F.col(f"v_{name}") for name in V]
    bins = near.withColumn("bin", F.floor(64 * F.log2(F.lit(1.0) + 1024 * F.greatest("d2", F.lit(0.0))))).groupBy("group", "bin").agg(
        F.count("*").alias("c"),
        *[F.sum(v[i]).alias(f"s_{i}") for i in range(len(V))],
        *[F.sum(v[i] * v[j]).alias(f"s_{i}_{j}") for i, j in PAIRS],
    )
    nearer = W.Window.partitionBy("group").orderBy("bin").rowsBetween(W.Window.unboundedPreceding, -1)
    bins = bins.withColumn("nearer", F.coalesce(F.sum("c").over(nearer), F.lit(0)))
    inside = join_small(bins, groups, "group", "inner", n_groups).where(F.col("nearer") < F.ceil(COVERED * F.col("n")))
    names = ["c", *[f"s_{i}" for i in range(len(V))], *[f"s_{i}_{j}" for i, j in PAIRS]]
    return inside.groupBy("group").agg(*[F.sum(x).alias(x) for x in names])


def estimates(counted: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The group of each language and source, the estimate of each group, and how many groups there are.

    ``counted`` needs own_group, lang_group, base_failed and the vector. Starts from the texts nearest
    to the medians and repeats the concentration step until no estimate changes (20 times at most).
    """
    of_group, groups = _with_group(counted)
    groups = stored(groups, "groups")
    n_groups = of_group.count()
    usable = join_small(counted.where(~F.col("base_failed")), of_group, "own_group", "inner", n_groups)
    usable = join_small(usable, groups.select("group"), "group", "inner", n_groups)
    limit = _chi2_limit(1 - COVERED, len(V))
    factor = COVERED / (1 - _chi2_tail(limit, len(V) + 2))
    medians = stored(usable.groupBy("group").agg(*[F.percentile(f"v_{n}", F.lit(0.5)).alias(f"m_{i}") for i, n in enumerate(V)]), "medians")
    first = medians.select(
        "group", *[f"m_{i}" for i in range(len(V))],
        *[F.lit(1 / (FLOORS[V[i]] * UNIT) ** 2 if i == j else 0.0).alias(f"p_{i}_{j}") for i, j in PAIRS],
    )
    now, sums = first, None
    for _ in range(MAX_STEPS):
        near = join_small(usable, now, "group", "inner", n_groups).withColumn("d2", _distance())
        before, sums = sums, stored(_covered_sums(near, groups, n_groups), "moments")
        now = _inverse(sums, factor)
        if before is not None and sums.exceptAll(before).isEmpty():
            break
    return of_group, stored(now, "estimates"), n_groups


def _counted(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """Statistics, vector and group names of every text, written once."""
    own = F.to_json(F.struct(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")))
    lang = F.concat(F.lit("*"), F.to_json(F.struct(F.col("lang").cast("string").alias("lang"))))
    rows = with_statistics(docs, [*keep, own.alias("own_group"), lang.alias("lang_group")])
    return stored(rows.select("*", base_failed().alias("base_failed"), *_vector()), "statistics")


def _judged(counted: DataFrame) -> DataFrame:
    of_group, estimate, n_groups = estimates(counted)
    judged = join_small(counted, of_group, "own_group", "left", n_groups)
    judged = join_small(judged, estimate, "group", "left", n_groups).withColumn("distance2", _distance())
    fits = F.coalesce(F.col("distance2") <= _chi2_limit(REJECT, len(V)), F.lit(True))
    return judged.withColumn("kept", ~F.col("base_failed") & fits)


def assess_quality(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang, source; other columns are not read).

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    distance2``. Null or empty text: all counts 0, so base_failed. Null language or source: a group
    of its own. A language and source of fewer than 50 usable texts is held against the texts of all
    such sources of its language; where those are fewer than 50, only the base rules decide and
    distance2 is null. Repeated rows are judged alike. No rows: none.
    """
    counted = _counted(docs, [F.col("doc_id")])
    return _judged(counted).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance2"
    )


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; texts are not shuffled."""
    counted = _counted(docs, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")])
    return _judged(counted).where("kept").select("__row.*")
