"""Small helpers of the training-data operators."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from clausegrid.session import shared_folder

SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
#: Rows up to which a table of parameters is broadcast; beyond it, it is joined by shuffling.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches and Parquet row groups of 16 MB at most from now on in this session, and shuffles end with their query.

    Rows can be long texts or sets, and tasks hold a batch and a row group at a time. What is stored is read again
    from its folder, so the shuffle files it was made from need not wait for the driver's garbage collection.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("parquet.block.size", str(16 << 20))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


class _Open(threading.local):
    """Of this thread, the folders written since each open ``alone`` began."""

    def __init__(self):
        self.folders: list[list[str]] = []


_OPEN = _Open()


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows written once to the shared folder and read again: lineage ends there."""
    return stored_in_parts([df], purpose)


def stored_in_parts(parts: Iterable[DataFrame], purpose: str) -> DataFrame:
    """The rows of all the parts, which have equal columns, written one after the other as one ``stored`` table."""
    path = None
    for df in parts:
        bound_batches(df.sparkSession)
        path = path or shared_folder(df.sparkSession, purpose)
        df.write.mode("append").option("compression", "zstd").parquet(path)
    if _OPEN.folders:
        _OPEN.folders[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def alone(spark: SparkSession, build: Callable[[], DataFrame], purpose: str) -> DataFrame:
    """``build()``, stored; the tables that it stored on its way are removed then.

    Nothing but the result may read those tables.
    """
    _OPEN.folders.append([])
    try:
        result = stored(build(), purpose)
    finally:
        written = _OPEN.folders.pop()
    if _OPEN.folders:
        _OPEN.folders[-1].append(written[-1])
    for folder in written[:-1]:
        removed(spark, folder)
    return result


def dropped(table: DataFrame) -> None:
    """Removes the folder of a ``stored`` table that nothing reads any more."""
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        removed(table.sparkSession, folder)


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The runs of ``[^\\x20\\x09-\\x0D]`` of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def count_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def join_small(rows: DataFrame, params: DataFrame, on, how: str, n_params: int) -> DataFrame:
    """Join with a table of parameters whose row count the caller has counted."""
    return rows.join(F.broadcast(params) if n_params <= BROADCAST_ROWS else params, on, how)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Zero-based position of every row in a total order, without gathering the rows in one task.

    Rows are dealt by ranges of the order and written with the number of their range; the totals
    of the ranges (one row each) are summed, and positions are counted inside each range.
    """
    dealt = stored(
        df.repartitionByRange(32, *order).withColumn("__range", F.spark_partition_id()), "ranges"
    )
    before = W.Window.orderBy("__range").rowsBetween(W.Window.unboundedPreceding, -1)
    starts = (
        dealt.groupBy("__range")
        .agg(F.count("*").alias("__n"))
        .select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    )
    inside = F.row_number().over(W.Window.partitionBy("__range").orderBy(*order)) - 1
    return (
        dealt.join(starts, "__range")
        .withColumn(name, F.col("__start") + inside)
        .drop("__range", "__start")
    )


#: A table ``crc`` with the list ``tab`` of the 256 steps of CRC-32, for the check SQL.
CRC_TABLE_SQL = """crc AS (SELECT list(c ORDER BY b) AS tab FROM (SELECT b, list_reduce(list_prepend(b, range(8)),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END) AS c FROM range(256) r(b)))"""


def crc32_sql(ascii_text: str) -> str:
    """CRC-32 of an ASCII string in SQL that reads ``crc``."""
    codes = f"list_transform(string_split({ascii_text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    step = "lambda c, x: xor(tab[xor(c % 256, x) + 1], c // 256)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), {step}), 4294967295)"
