"""JSON lines with a problem for every bad line, and tables replaced or appended by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from clausegrid.functions import text as T
from clausegrid.functions.scan import running_count
from clausegrid.sources import layers


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value): lines numbered through each file, split by split."""
    raw = spark.read.text(path).select(
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )
    numbered = running_count(raw, ["file"], {"block": F.col("block")}, ["place"], "line_no")
    return numbered.select("file", "line_no", "value")


def jsonl_with_errors(lines: DataFrame, schema: S.StructType) -> tuple[DataFrame, DataFrame]:
    """(parsed rows, problems): a line that is no JSON, or no object, is reported with its number."""
    kept = lines.where(T.strip(F.col("value")) != "")
    shaped = S.StructType([*schema.fields, S.StructField("__bad", S.StringType())])
    parsed = kept.withColumn(
        "__row", F.from_json("value", shaped, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    )
    is_object = F.col("value").rlike(r"^\s*\{")
    broken = F.col("__row.__bad").isNotNull() | F.col("__row").isNull()
    problem = F.when(broken & is_object, "not JSON").when(
        ~is_object, F.when(F.col("value").rlike(r"^\s*([\[\"0-9-]|true|false|null)"), "not a JSON object").otherwise("not JSON")
    )
    marked = parsed.withColumn("problem", problem)
    good = marked.where("problem IS NULL").select("file", "line_no", *[F.col(f"__row.{f.name}").alias(f.name) for f in schema.fields])
    return good, marked.where("problem IS NOT NULL").select("file", "line_no", "problem")


def replace_by_key(df: DataFrame, path: str, key: str) -> None:
    """Rows of ``df`` take the place of those stored under their keys; running it twice leaves one copy.

    The table is read by ``layers.read``: before the one step that makes the new rows visible it gives the
    old ones, whole, and after it the new ones. Rows without a key share one place.
    """
    layers.replace_parts(df, path, key)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
