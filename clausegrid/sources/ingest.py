"""Deciding what a batch of documents adds to the stored corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.session import cut_lineage


def classify_ingest(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Outcome of every incoming row: skipped, conflict, failed or ingested.

    Incoming: batch_order, checksum, circular_number, has_text. Stored: checksum,
    circular_number. Rows count as if stored one after the other: a row is skipped when its
    checksum is stored or came in before, a conflict when its number did, failed without text.
    Rounds settle every row that is first for both its checksum and its number among the rows
    still open, which gives what going row by row would; nearly always one round is enough. A row without
    checksum or number is nobody's copy or conflict in that respect.
    """
    # What a row does not know it shares with no other row.
    own = lambda name: F.coalesce(name, F.concat(F.lit("\u0000"), F.col("batch_order").cast("string"))).alias(name)
    sums = stored.select("checksum").distinct()
    numbers = stored.select("circular_number").distinct()
    open_ = cut_lineage(
        incoming.where("has_text")
        .select("batch_order", own("checksum"), own("circular_number"))
        .join(sums, "checksum", "left_anti")
        .join(numbers, "circular_number", "left_anti")
    )
    taken = None
    while True:
        by_sum = open_.groupBy("checksum").agg(F.min("batch_order").alias("batch_order"))
        by_number = open_.groupBy("circular_number").agg(F.min("batch_order").alias("batch_order"))
        first = cut_lineage(open_.join(by_sum, ["checksum", "batch_order"]).join(by_number, ["circular_number", "batch_order"]))
        taken = first if taken is None else taken.unionByName(first)
        open_ = cut_lineage(
            open_.join(first.select("checksum"), "checksum", "left_anti").join(
                first.select("circular_number"), "circular_number", "left_anti"
            )
        )
        if open_.isEmpty():
            break
    before = F.lit(-1).cast("long").alias("__at")
    sum_at = (
        taken.select("checksum", F.col("batch_order").cast("long").alias("__at"))
        .unionByName(sums.select("checksum", before))
        .groupBy("checksum")
        .agg(F.min("__at").alias("__sum_at"))
    )
    number_at = (
        taken.select("circular_number", F.col("batch_order").cast("long").alias("__at"))
        .unionByName(numbers.select("circular_number", before))
        .groupBy("circular_number")
        .agg(F.min("__at").alias("__number_at"))
    )
    joined = incoming.join(sum_at, "checksum", "left").join(number_at, "circular_number", "left")
    at = F.col("batch_order")
    outcome = (
        F.when(F.col("__sum_at") < at, "skipped")
        .when(F.col("__number_at") < at, "conflict")
        .when(~F.col("has_text"), "failed")
        .otherwise("ingested")
    )
    return joined.withColumn("outcome", outcome).drop("__sum_at", "__number_at")


def ingest_report(classified: DataFrame) -> DataFrame:
    """One row: outcomes counted, pages and the share read by the vision path (0 without pages)."""
    done = F.col("outcome") == "ingested"
    summed = classified.agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("ingested", "skipped", "conflict", "failed")],
        F.coalesce(F.sum(F.when(done, F.col("pages"))), F.lit(0)).alias("total_pages"),
        F.coalesce(F.sum(F.when(done, F.col("vision_pages"))), F.lit(0)).alias("vision_pages"),
    )
    share = F.when(F.col("total_pages") > 0, F.col("vision_pages") / F.col("total_pages")).otherwise(0.0)
    return summed.withColumn("vision_fraction", share)
