"""Policy manuals in markdown to numbered clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clausegrid.functions import fixed as K
from clausegrid.functions import text as T


def parse_policy_clauses(manuals: DataFrame, key: str = "manual_id") -> DataFrame:
    """(manual_id, markdown) → clauses with heading, part in force and offsets into the manual.

    Every heading opens a section that runs to the next heading of any level, so the manual is
    cut once at headings; windows stay inside one manual, which is one text value.
    """
    sections = manuals.select(
        key, F.inline(T.split_with_offsets(F.col("markdown"), r"\n(?=#)"))
    )
    order = W.partitionBy(key).orderBy("start")
    head = T.U + "(?m)" + K.CLAUSE_HEADING
    part = T.strip(F.regexp_extract("piece", T.U + "(?m)" + K.PART_HEADING, 1))
    is_part = T.found(F.col("piece"), r"^##\s")
    body = T.rstrip(F.col("piece"))
    ruled = T.rstrip(F.regexp_replace(body, T.U + r"\n+---\s*$", ""))
    marked = sections.withColumns(
        {
            "heading_path": F.coalesce(
                F.last(F.when(is_part, part), ignorenulls=True).over(
                    order.rowsBetween(W.unboundedPreceding, -1)
                ),
                F.lit(""),
            ),
            "clause_number": F.regexp_extract("piece", head, 1),
            "heading": F.regexp_extract("piece", head, 2),
            "text": ruled,
        }
    )
    clauses = marked.where(T.found(F.col("piece"), r"^###\s+[A-Z]\.\d+\s") & (F.col("clause_number") != ""))
    return clauses.select(
        key,
        (F.row_number().over(order) - 1).alias("order_index"),
        "clause_number",
        "heading",
        "heading_path",
        "text",
        F.col("start").alias("char_start"),
        (F.col("start") + F.length("text")).alias("char_end"),
    )


def new_packs(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Manuals whose (name, version) is not indexed yet; indexing one again is a no-op."""
    return incoming.join(stored.select("name", "version"), ["name", "version"], "left_anti")


def pack_overview(packs: DataFrame, clauses: DataFrame) -> DataFrame:
    counts = clauses.groupBy(F.col("policy_pack_id").alias("id")).agg(F.count("*").alias("clauses"))
    return packs.join(counts, "id", "left").withColumn("clauses", F.coalesce("clauses", F.lit(0)))
