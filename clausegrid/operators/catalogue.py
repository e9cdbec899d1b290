"""Looking up and listing circulars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def like_search(circulars: DataFrame, text: str) -> DataFrame:
    """Number or title contains ``text``, case ignored; wildcards in it mean themselves."""
    wanted = F.lower(F.lit(text.strip()))
    return circulars.where(
        F.contains(F.lower("circular_number"), wanted) | F.contains(F.lower("title"), wanted)
    )


def page_listing(circulars: DataFrame, obligations: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One page, newest first and undated last, with obligation counts; counts join after the cut."""
    page = (
        circulars.select("id", "circular_number", "title", "issue_date", "department", "doc_type")
        .orderBy(F.col("issue_date").desc_nulls_last(), F.col("id").desc())
        .offset(offset)
        .limit(limit)
    )
    counts = (
        obligations.select(F.col("circular_id").alias("id"))
        .join(page.select("id"), "id", "left_semi")
        .groupBy("id")
        .agg(F.count("*").alias("obligations"))
    )
    return page.join(counts, "id", "left").withColumn("obligations", F.coalesce("obligations", F.lit(0)))


def listing_total(circulars: DataFrame) -> DataFrame:
    return circulars.agg(F.count("*").alias("total"))


def distinct_departments(circulars: DataFrame) -> DataFrame:
    return circulars.where("department IS NOT NULL").select("department").distinct()


def lookup_many(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose id is in the set."""
    return rows.join(ids.select("id").distinct(), "id", "left_semi")
