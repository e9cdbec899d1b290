"""Citation graph: references bound to circulars, supersession edges, and views of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions import fixed as K
from clausegrid.functions import text as T
from clausegrid.functions.scan import left_join_spread


def number_lookup(circulars: DataFrame) -> DataFrame:
    """One circular per normalised number: an undated one first, else the oldest, then the lowest id."""
    choice = F.struct(F.col("issue_date").isNotNull().alias("dated"), "issue_date", "id")
    return (
        circulars.withColumn("normalised_reference", T.normalise_reference(F.col("circular_number")))
        .groupBy("normalised_reference")
        .agg(F.min(choice)["id"].alias("number_target"))
    )


def date_lookup(circulars: DataFrame) -> DataFrame:
    """Issue dates that belong to exactly one circular."""
    return (
        circulars.where(F.col("issue_date").isNotNull())
        .groupBy("issue_date")
        .agg(F.count("*").alias("n"), F.min("id").alias("date_target"))
        .where("n = 1")
        .drop("n")
    )


def resolve_citations(references: DataFrame, phrases: DataFrame, circulars: DataFrame) -> DataFrame:
    """Bind references by number, else by the paragraph's first unambiguous 'dated' phrase.

    ``references``: circular_id, paragraph_id, raw_reference, normalised_reference, char_start,
    char_end. ``phrases``: paragraph_id, char_start, parsed. A circular's own number is dropped.
    """
    by_date = (
        phrases.where(F.col("parsed").isNotNull())
        .join(date_lookup(circulars), F.col("parsed") == F.col("issue_date"))
        .groupBy("paragraph_id")
        .agg(F.min_by("date_target", "char_start").alias("date_target"))
    )
    bound = references.join(number_lookup(circulars), "normalised_reference", "left").join(
        by_date, "paragraph_id", "left"
    )
    target = F.coalesce("number_target", "date_target")
    method = (
        F.when(F.col("number_target").isNotNull(), "regex")
        .when(F.col("date_target").isNotNull(), "date")
        .otherwise("unresolved")
    )
    return bound.where(target.isNull() | (target != F.col("circular_id"))).select(
        F.col("circular_id").alias("citing_circular_id"),
        F.col("paragraph_id").alias("citing_paragraph_id"),
        "raw_reference",
        "normalised_reference",
        target.alias("cited_circular_id"),
        target.isNotNull().alias("resolved"),
        method.alias("resolution_method"),
        "char_start",
        "char_end",
    )


def supersession_edges(citations: DataFrame, paragraphs: DataFrame, circulars: DataFrame) -> DataFrame:
    """A cue makes an edge of every reference of its paragraph, effective when the citer was issued."""
    cues = paragraphs.select(
        F.col("id").alias("citing_paragraph_id"), T.supersession_cue(F.col("text")).alias("supersession_type")
    ).where(F.col("supersession_type").isNotNull())
    issued = circulars.select(
        F.col("id").alias("citing_circular_id"), F.col("issue_date").alias("effective_date")
    )
    return (
        citations.join(cues, "citing_paragraph_id")
        .join(issued, "citing_circular_id", "left")
        .select(
            F.col("citing_circular_id").alias("superseding_circular_id"),
            F.col("cited_circular_id").alias("superseded_circular_id"),
            "raw_reference",
            F.col("citing_paragraph_id").alias("evidence_paragraph_id"),
            "char_start",
            "supersession_type",
            "effective_date",
            "resolved",
        )
    )


def graph_report(citations: DataFrame, supersessions: DataFrame, circulars: DataFrame, examples: int = 20) -> DataFrame:
    """One row: edges found and resolved, the resolution rate, and the first unresolved references."""
    c = citations.agg(
        F.count("*").alias("citations_found"), F.count_if("resolved").alias("citations_resolved")
    )
    s = supersessions.agg(
        F.count("*").alias("supersessions_found"), F.count_if("resolved").alias("supersessions_resolved")
    )
    dated = circulars.select(F.col("id").alias("citing_circular_id"), "issue_date")
    order = [
        F.col("issue_date").desc_nulls_last(),
        F.col("citing_circular_id").desc(),
        F.col("citing_paragraph_id").asc(),
        F.col("char_start").asc(),
    ]
    place = F.struct(
        F.col("issue_date").isNull().alias("undated"),
        (-F.unix_date("issue_date")).alias("newest"),
        (-F.col("citing_circular_id")).alias("last"),
        "citing_paragraph_id",
        "char_start",
        "raw_reference",
    )
    shown = (
        citations.where(~F.col("resolved"))
        .join(dated, "citing_circular_id")
        .orderBy(*order)
        .limit(examples)
        .agg(F.array_join(F.array_sort(F.collect_list(place))["raw_reference"], "|").alias("unresolved_examples"))
    )
    one = F.lit(1).alias("__one")
    joined = (
        c.select("*", one).join(s.select("*", one), "__one").join(shown.select("*", one), "__one").drop("__one")
    )
    rate = F.when(
        F.col("citations_found") > 0, F.col("citations_resolved") / F.col("citations_found")
    ).otherwise(0.0)
    return joined.withColumn("resolution_rate", rate)


def resolution_stats(citations: DataFrame) -> DataFrame:
    return citations.agg(F.count_if("resolved").alias("resolved"), F.count("*").alias("total"))


def outbound_edges(citations: DataFrame, circulars: DataFrame) -> DataFrame:
    """Citations made, with number and title of the cited circular where it is known."""
    cited = circulars.select(
        F.col("id").alias("cited_circular_id"),
        F.col("circular_number").alias("cited_number"),
        F.col("title").alias("cited_title"),
    )
    return left_join_spread(citations, cited, "cited_circular_id")


def inbound_edges(citations: DataFrame, circulars: DataFrame) -> DataFrame:
    """Resolved citations received, with number and title of the citing circular."""
    citing = circulars.select(
        F.col("id").alias("citing_circular_id"),
        F.col("circular_number").alias("citing_number"),
        F.col("title").alias("citing_title"),
    )
    return citations.where(F.col("cited_circular_id").isNotNull()).join(citing, "citing_circular_id", "left")


def removes_from_force(kind: Column) -> Column:
    return kind.isin(*K.REMOVES_FROM_FORCE)


def amendment_chain(supersessions: DataFrame) -> DataFrame:
    """Each edge seen from both of its ends; two projections, so no join on either-or."""
    shared = [
        "edge_id",
        "superseding_circular_id",
        "superseded_circular_id",
        "supersession_type",
        "effective_date",
        "resolved",
    ]
    kept = supersessions.withColumn("removes_from_force", removes_from_force(F.col("supersession_type")))
    out = kept.select(
        F.col("superseding_circular_id").alias("circular_id"), F.lit("outgoing").alias("direction"), *shared, "removes_from_force"
    )
    into = kept.where(
        F.col("superseded_circular_id").isNotNull()
        & (F.col("superseded_circular_id") != F.col("superseding_circular_id"))
    ).select(
        F.col("superseded_circular_id").alias("circular_id"), F.lit("incoming").alias("direction"), *shared, "removes_from_force"
    )
    return out.unionByName(into)
