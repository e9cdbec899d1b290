"""Rows, links and document numbers out of harvested listing pages."""

from __future__ import annotations

import html
from urllib.parse import parse_qs, urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from clausegrid.functions import fixed as K
from clausegrid.functions import text as T


@F.pandas_udf(S.StringType())
def unescaped(titles: pd.Series) -> pd.Series:
    return titles.map(html.unescape, na_action="ignore")


@F.pandas_udf(S.StringType())
def resolved_link(base: pd.Series, href: pd.Series) -> pd.Series:
    """Absolute address of a link, or the ``file`` it wraps."""

    def one(b, h):
        if h is None:
            return None
        url = urljoin(b, h)
        wrapped = parse_qs(urlparse(url).query).get("file")
        return wrapped[0] if wrapped else url

    return pd.Series([one(b, h) for b, h in zip(base, href)], dtype="object")


def listing_rows(pages: DataFrame, pattern: str = K.LISTING_ROW, date_format: str = "MMM dd, yyyy") -> DataFrame:
    """(page_id, html) → one row per listed document: date, href, title without entities."""
    groups = [F.regexp_extract_all("html", F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "date"), (2, "href"), (3, "title"))]
    rows = pages.select("page_id", F.inline(F.arrays_zip(*groups)))
    title = F.when(F.contains("title", F.lit("&")), unescaped(F.col("title"))).otherwise(F.col("title"))
    return rows.select(
        "page_id",
        F.try_to_timestamp("date", F.lit(date_format)).cast("date").alias("issued"),
        F.col("href").alias("page_url"),
        T.strip(title).alias("title"),
    )


def document_links(pages: DataFrame, hosted: str = K.HOSTED_FILE, linked: str = K.LINKED_FILE) -> DataFrame:
    """(page_id, url, html) → the page's document: a hosted file, else its first linked file."""
    direct = T.blank_to_null(F.regexp_extract("html", hosted, 1))
    href = T.blank_to_null(F.regexp_extract("html", linked, 1))
    rows = pages.select("page_id", "url", direct.alias("direct"), href.alias("href"))
    return rows.select("page_id", F.coalesce("direct", resolved_link(F.col("url"), F.col("href"))).alias("document_url"))


def title_selected(
    title: Column, include: tuple[str, ...] = K.INCLUDE_KEYWORDS, exclude: tuple[str, ...] = K.EXCLUDE_KEYWORDS
) -> Column:
    any_of = lambda words: F.lower(title).rlike("|".join(quoted(w) for w in words))
    return any_of(include) & ~any_of(exclude)


def quoted(word: str) -> str:
    return r"\Q" + word + r"\E"


def select_by_keywords(rows: DataFrame, limit: int, include=K.INCLUDE_KEYWORDS, exclude=K.EXCLUDE_KEYWORDS) -> DataFrame:
    """The newest ``limit`` rows whose title holds a wanted word and no unwanted one."""
    kept = rows.where(title_selected(F.col("title"), include, exclude))
    return kept.orderBy(F.col("issued").desc(), F.col("page_url").asc()).limit(limit)


def harvest_number(pages: DataFrame, first: int = 2) -> DataFrame:
    """(doc_id, page_number, text) → the number printed on the first pages, and a safe file name."""
    head = (
        pages.where(F.col("page_number") <= first)
        .groupBy("doc_id")
        .agg(F.array_join(F.array_sort(F.collect_list(F.struct("page_number", "text")))["text"], " ").alias("text"))
    )
    joined = F.regexp_replace("text", T.U + r"/\s+", "/")
    number = T.blank_to_null(F.regexp_replace(F.regexp_extract(joined, K.PRINTED_NUMBER, 1), "/+$", ""))
    name = F.regexp_replace(F.regexp_replace(F.col("number"), r"[^A-Za-z0-9_\-]+", "_"), "^_+|_+$", "")
    return head.select("doc_id", number.alias("number")).withColumn("filename", F.concat(name, F.lit(".pdf")))
