"""Continuous ingestion: every micro-batch is decided against what is stored so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.session import cut_lineage
from clausegrid.sources import layers
from clausegrid.sources.ingest import classify_ingest

#: Folders the stored keys are dealt over; a batch opens only those its own keys fall into.
BUCKETS = 64
STORE = "kind string, value string, batch long, bucket int"
KEYS = ("checksum", "circular_number")


def stored_keys(rows: DataFrame, batch_id: int) -> DataFrame:
    """(kind, value, batch, bucket): the checksums and numbers of rows, as the store keeps them."""
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in KEYS))
    keys = rows.select(F.inline(pairs)).where("value IS NOT NULL").distinct()
    bucket = F.pmod(F.xxhash64("kind", "value"), F.lit(BUCKETS)).cast("int")
    return keys.select("kind", "value", F.lit(batch_id).cast("long").alias("batch"), bucket.alias("bucket"))


def merged(keys: DataFrame) -> DataFrame:
    """Each key once, with the batch that brought it first."""
    return keys.groupBy("bucket", "kind", "value").agg(F.min("batch").alias("batch")).select("kind", "value", "batch", "bucket")


def held(batch: DataFrame, stored_path: str, batch_id: int) -> DataFrame:
    """(checksum, circular_number): what earlier batches stored of this batch's keys, one of the two in each row.

    The buckets that the batch hits (at most ``BUCKETS`` numbers) choose the folders that are read.
    """
    spark = batch.sparkSession
    asked = stored_keys(batch, batch_id)
    hit = [r["bucket"] for r in asked.select("bucket").distinct().collect()]
    store = layers.read(spark, stored_path, STORE).where(F.col("bucket").isin(hit) & (F.col("batch") < batch_id))
    found = store.join(asked.select("bucket", "kind", "value"), ["bucket", "kind", "value"], "left_semi")
    return found.select(*(F.when(F.col("kind") == k, F.col("value")).alias(k) for k in KEYS))


def ingest_batch(stored_path: str, outcome_path: str):
    """``foreachBatch`` writer: classify the batch, log outcomes, add its new rows' keys to the store.

    The store is layered (``layers``): a batch adds one folder, small ones are merged, and the new state
    shows at once. Outcomes lie in a folder named after the batch. A batch that is run again after a
    failure sees only keys of earlier batches, decides the same and replaces what it had written.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = cut_lineage(batch)
        decided = classify_ingest(batch, cut_lineage(held(batch, stored_path, batch_id)))
        decided.write.mode("overwrite").parquet(f"{outcome_path}/batch={batch_id}")
        done = spark.read.parquet(f"{outcome_path}/batch={batch_id}").where(F.col("outcome") == "ingested")
        layers.add(stored_keys(done, batch_id), stored_path, batch_id, merged, ["bucket"])

    return write


def stream_ingest(documents: DataFrame, stored_path: str, outcome_path: str, checkpoint: str):
    """Start the stream: documents carry batch_order, checksum, circular_number and has_text."""
    return (
        documents.writeStream.foreachBatch(ingest_batch(stored_path, outcome_path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
