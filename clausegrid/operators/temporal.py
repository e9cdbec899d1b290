"""What was in force on a date.

Many dates need no range join: a circular leaves force once, at its earliest removal, so the
edges shrink to one date per circular and each question is a comparison with it.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.operators.graph import removes_from_force


def removals(supersessions: DataFrame) -> DataFrame:
    """Earliest date each circular is out of force, and the edge that did it."""
    applied = supersessions.where(
        F.col("resolved")
        & F.col("superseded_circular_id").isNotNull()
        & F.col("effective_date").isNotNull()
        & removes_from_force(F.col("supersession_type"))
    )
    return (
        applied.groupBy(F.col("superseded_circular_id").alias("id"))
        .agg(F.min(F.struct("effective_date", "edge_id")).alias("first"))
        .select("id", F.col("first.effective_date").alias("out_since"), F.col("first.edge_id").alias("out_by"))
    )


def each_date(df: DataFrame, dates: list[date]) -> DataFrame:
    return df.withColumn("as_of", F.explode(F.array(*[F.lit(d) for d in dates])))


def out_of_force_ids(supersessions: DataFrame, dates: list[date]) -> DataFrame:
    return each_date(removals(supersessions), dates).where("out_since <= as_of").select("as_of", "id")


def in_force_as_of(circulars: DataFrame, supersessions: DataFrame, dates: list[date]) -> DataFrame:
    """(as_of, id) of circulars issued by the date and not out of force on it; undated ones never."""
    joined = circulars.select("id", "issue_date").join(removals(supersessions), "id", "left")
    return (
        each_date(joined.where(F.col("issue_date").isNotNull()), dates)
        .where("issue_date <= as_of AND (out_since IS NULL OR out_since > as_of)")
        .select("as_of", "id")
    )


def force_state(circulars: DataFrame, supersessions: DataFrame, dates: list[date]) -> DataFrame:
    """State of every circular on every date, with counts of amending and undated removing edges.

    The counts come from two cumulative facts per circular and date, so a circular with very
    many amendments needs no list; ``amending_edges`` gives them row by row.
    """
    removing = removes_from_force(F.col("supersession_type"))
    incoming = supersessions.where(F.col("resolved") & F.col("superseded_circular_id").isNotNull())
    counts = incoming.groupBy(F.col("superseded_circular_id").alias("id")).agg(
        F.count_if(removing & F.col("effective_date").isNull()).alias("undated"),
        *[
            F.count_if(~removing & (F.col("effective_date").isNull() | (F.col("effective_date") <= F.lit(d)))).alias(
                f"__amended_{i}"
            )
            for i, d in enumerate(dates)
        ],
    )
    joined = (
        circulars.select("id", "issue_date")
        .join(removals(supersessions), "id", "left")
        .join(counts, "id", "left")
    )
    each = joined.select(
        "id",
        "issue_date",
        "out_since",
        "out_by",
        "undated",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(d).alias("as_of"), F.col(f"__amended_{i}").alias("amended"))
                    for i, d in enumerate(dates)
                ]
            )
        ),
    )
    state = (
        F.when(F.col("issue_date").isNull(), "unknown-date")
        .when(F.col("issue_date") > F.col("as_of"), "not-issued")
        .when(F.col("out_since") <= F.col("as_of"), "out-of-force")
        .otherwise("in-force")
    )
    marked = each.withColumn("state", state)
    out, held = F.col("state") == "out-of-force", F.col("state") == "in-force"
    return marked.select(
        "id",
        "as_of",
        "state",
        F.when(out, F.col("out_since")).alias("since"),
        F.when(out, F.col("out_by")).alias("by_edge"),
        F.when(held, F.coalesce("amended", F.lit(0))).alias("amended_by"),
        F.when(held, F.coalesce("undated", F.lit(0))).alias("undated_removals"),
    )


def amending_edges(supersessions: DataFrame, dates: list[date]) -> DataFrame:
    """(as_of, id, edge_id) of amendments that had taken effect, or have no date."""
    kept = supersessions.where(
        F.col("resolved")
        & F.col("superseded_circular_id").isNotNull()
        & ~removes_from_force(F.col("supersession_type"))
    )
    return (
        each_date(kept, dates)
        .where("effective_date IS NULL OR effective_date <= as_of")
        .select("as_of", F.col("superseded_circular_id").alias("id"), "edge_id")
    )


def timeline(circulars: DataFrame, chain: DataFrame, on: date) -> DataFrame:
    """Every circular as the selected one, with its direct neighbours and how they relate to it.

    Sorting by (selected_id, issue_date) gives the spine; ``after_marker`` splits it at ``on``.
    ``chain`` is the result of ``amendment_chain``.
    """
    outgoing = F.col("direction") == "outgoing"
    other = F.when(outgoing, F.col("superseded_circular_id")).otherwise(F.col("superseding_circular_id"))
    place = F.struct(F.col("effective_date").isNull().alias("undated"), "effective_date", "edge_id")
    edges = (
        chain.withColumn("neighbour_id", other)
        .where(F.col("neighbour_id").isNotNull() & (F.col("neighbour_id") != F.col("circular_id")))
        .groupBy(F.col("circular_id").alias("selected_id"), "neighbour_id")
        .agg(
            F.min_by(F.struct("direction", "supersession_type", "effective_date"), place).alias("edge")
        )
    )
    amends = F.col("edge.supersession_type") == "amends"
    verb = (
        F.when((F.col("edge.direction") == "outgoing") & amends, "Amended by the selected circular")
        .when(F.col("edge.direction") == "outgoing", "Taken out of force by the selected circular")
        .when(amends, "Amends the selected circular")
        .otherwise("Takes the selected circular out of force")
    )
    when = F.coalesce(
        F.concat(F.lit(" from "), F.date_format("edge.effective_date", "yyyy-MM-dd")),
        F.lit(" (no effective date recorded)"),
    )
    dates = circulars.select(F.col("id").alias("neighbour_id"), "issue_date")
    around = edges.join(dates, "neighbour_id").select(
        "selected_id", "neighbour_id", "issue_date", F.concat(verb, when).alias("relation")
    )
    own = circulars.select(
        F.col("id").alias("selected_id"),
        F.col("id").alias("neighbour_id"),
        "issue_date",
        F.lit(None).cast("string").alias("relation"),
    )
    return own.unionByName(around).withColumn(
        "after_marker", F.coalesce(F.col("issue_date") > F.lit(on), F.lit(False))
    )


def marker_position(spine: DataFrame) -> DataFrame:
    """How many entries stand before the date marker of each selected circular."""
    return spine.groupBy("selected_id").agg(F.count_if(~F.col("after_marker")).alias("marker_at"))
