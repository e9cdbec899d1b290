"""Token counts: an exact histogram of encoded lengths, and suffix sums for every context limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from clausegrid.llm import bpe

#: Lengths of one block; sums run over blocks first and inside each block then.
BLOCK = 1024


def encoded_lengths(docs: DataFrame, path: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys`` and ``length``, the number of tokens of each text; 0 for null."""
    return bpe.encode(docs, path, keys).select(*keys, (F.octet_length("ids") / 4).cast("long").alias("length"))


def length_histogram(lengths: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, length, n_docs``: how many documents have each length that occurs."""
    return lengths.groupBy(*keys, "length").agg(F.count("*").alias("n_docs"))


def context_totals(histogram: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """A row for each key and occurring length L, with what a context limit of L means.

    ``n_docs`` of that length, ``docs_longer`` (above L), ``total_docs``, ``total_tokens``,
    ``truncated_tokens`` (every document cut at L) and ``share_within`` (quantile: the share of documents
    that fit). For a limit between two rows ``truncated_at`` gives the total from these sums. A null key is
    a key of its own; no rows: none.
    """
    block = F.floor(F.col("length") / BLOCK)
    rows = histogram.withColumn("__block", block).withColumn("__tokens", F.col("length") * F.col("n_docs"))
    sums = rows.groupBy(*keys, "__block").agg(F.sum("n_docs").alias("__n"), F.sum("__tokens").alias("__t"))
    later = W.Window.partitionBy(*keys).orderBy(F.desc("__block")).rowsBetween(W.Window.unboundedPreceding, -1)
    whole = W.Window.partitionBy(*keys)
    sums = sums.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        F.col("__block").alias("__b"),
        F.coalesce(F.sum("__n").over(later), F.lit(0)).alias("__n_later"),
        F.coalesce(F.sum("__t").over(later), F.lit(0)).alias("__t_later"),
        F.sum("__n").over(whole).alias("total_docs"),
        F.sum("__t").over(whole).alias("total_tokens"),
    )
    same = F.col("__block") == F.col("__b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    inside = W.Window.partitionBy(*keys, "__block").orderBy(F.desc("length")).rowsBetween(W.Window.unboundedPreceding, -1)
    longer = F.col("__n_later") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0))
    tokens_longer = F.col("__t_later") + F.coalesce(F.sum("__tokens").over(inside), F.lit(0))
    out = rows.join(sums, same).select("*", longer.alias("docs_longer"), tokens_longer.alias("__longer"))
    return out.select(
        *keys,
        "length",
        "n_docs",
        "docs_longer",
        "total_docs",
        "total_tokens",
        (F.col("total_tokens") - F.col("__longer") + F.col("length") * F.col("docs_longer")).alias("truncated_tokens"),
        ((F.col("total_docs") - F.col("docs_longer")) / F.col("total_docs")).alias("share_within"),
    )


def truncated_at(totals: DataFrame, limit: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, tokens``: the tokens left when every document is cut at ``limit``."""
    below = totals.where(F.col("length") <= limit)
    last = below.groupBy(*keys).agg(F.max_by(F.struct("truncated_tokens", "docs_longer", "length"), "length").alias("x"))
    known = last.select(*keys, (F.col("x.truncated_tokens") + (limit - F.col("x.length")) * F.col("x.docs_longer")).alias("tokens"))
    first = totals.groupBy(*keys).agg(F.min("length").alias("least"), F.first("total_docs").alias("n"))
    shorter = first.where(F.col("least") > limit).select(*keys, (F.col("n") * limit).alias("tokens"))
    return known.unionByName(shorter)


def quantile(totals: DataFrame, share: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys, length``: the least occurring length within which at least ``share`` of the documents lie."""
    return totals.where(F.col("share_within") >= share).groupBy(*keys).agg(F.min("length").alias("length"))
