"""Labelled queries mined from the citation graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.functions import fixed as K
from clausegrid.functions import text as T


def mine_gold_queries(citations: DataFrame, paragraphs: DataFrame, circulars: DataFrame) -> DataFrame:
    """Every resolved citation asks twice: by its prose without the reference, and by the reference.

    Both queries leave one pass over the joined rows.
    """
    p = paragraphs.select(F.col("id").alias("citing_paragraph_id"), "text", "order_index")
    citing = circulars.select(
        F.col("id").alias("citing_circular_id"), F.col("circular_number").alias("citing_circular")
    )
    cited = circulars.select(F.col("id").alias("cited_circular_id"), F.col("circular_number").alias("relevant"))
    rows = (
        citations.where("resolved")
        .join(p, "citing_paragraph_id")
        .join(citing, "citing_circular_id")
        .join(cited, "cited_circular_id")
    )
    key = F.substring(
        F.sha2(F.concat_ws("|", "citing_circular", F.col("order_index").cast("string"), "raw_reference"), 256), 1, 10
    )
    keyed = rows.withColumns({"key": key, "prose": T.strip_reference(F.col("text"), F.col("raw_reference"))})
    both = F.array(
        F.struct(F.lit("sem-").alias("tag"), F.lit("semantic").alias("subset"), F.col("prose").alias("query")),
        F.struct(F.lit("ident-").alias("tag"), F.lit("identifier").alias("subset"), F.col("raw_reference").alias("query")),
    )
    asked = keyed.select(
        "key", "relevant", "citing_circular", F.col("order_index").alias("citing_paragraph"), F.col("raw_reference").alias("reference"), F.inline(both)
    )
    return asked.where((F.col("subset") == "identifier") | (F.length("query") >= K.MIN_SEMANTIC_QUERY_CHARS)).select(
        F.concat("tag", "key").alias("query_id"),
        "subset",
        "query",
        F.array("relevant").alias("relevant"),
        "citing_circular",
        "citing_paragraph",
        "reference",
    )


def sample_clusters(queries: DataFrame, citations: int, seed: int = K.SAMPLE_SEED) -> DataFrame:
    """Queries of ``citations`` citations drawn without replacement; both queries of each are kept.

    The draw orders citation keys by a seeded hash, so it does not depend on partitioning.
    """
    key = F.substring_index("query_id", "-", -1)
    keys = queries.select(key.alias("__key")).distinct()
    drawn = keys.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), "__key")), "__key").limit(citations)
    return queries.withColumn("__key", key).join(drawn, "__key", "left_semi").drop("__key")


def refusal_queries(cases: DataFrame) -> DataFrame:
    """(id, query, should_refuse) as queries without a relevant document."""
    return cases.select(
        F.col("id").alias("query_id"),
        F.when(F.col("should_refuse"), "out_of_scope").otherwise("control").alias("subset"),
        "query",
        F.array().cast("array<string>").alias("relevant"),
        F.lit("").alias("citing_circular"),
        F.lit(-1).cast("long").alias("citing_paragraph"),
        F.lit("").alias("reference"),
    )
