"""Top-n per key and hash draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per key with their rank.

    Written as ``row_number() <= n`` so that Spark's window group limit keeps at most ``n``
    rows per key in every map task; a hot key never travels whole.
    """
    spec = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(spec)).where(F.col(rank) <= n)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_n(df, keys, order, 1, "__first").drop("__first")


def hash_draw(text: Column, n: Column) -> Column:
    """A draw in 0..n-1 from the first 8 hex digits of the MD5 of ``text``."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n
