"""Running values over long groups, in two levels.

A plain running window puts a whole group in one task. When one key holds a large share of
the rows that task decides the run time, so the group is cut into ranges: ``bucket`` columns
must grow with the order. Running values are taken inside each (key, range), the few range
totals are accumulated, and the two are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Keys are counted in so many slots; groups in slots of more rows than this (and than four times the mean) are cut.
SLOTS = 4096
HOT_ROWS = 200_000


def _slot(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")


def hot_slots(df: DataFrame, keys: list[str], rows: int = HOT_ROWS) -> list[int]:
    """Slots of keys that may hold a long group; only at most ``SLOTS`` counts come to the driver."""
    counts = {r[0]: r[1] for r in df.groupBy(_slot(keys)).count().collect()}
    most = max(rows, 4 * sum(counts.values()) / SLOTS)
    return sorted(slot for slot, n in counts.items() if n > most)


def running_totals(
    df: DataFrame,
    keys: list[str],
    bucket: dict[str, Column],
    order: list,
    totals: dict[str, Column],
    hot: list[int] | None = None,
) -> DataFrame:
    """Adds each name in ``totals`` as the sum of its expression up to and including the row.

    ``hot``: the ``hot_slots`` of the rows, when known. Only groups in them are cut into ranges then; all others are
    short and take one window, which shuffles each row once.
    """
    if hot is not None:
        whole = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        kept = [c for c in df.columns if c not in totals]
        short = df if not hot else df.where(~_slot(keys).isin(hot))
        once = short.select(*kept, *[F.sum(e).over(whole).alias(n) for n, e in totals.items()])
        if not hot:
            return once
        return once.unionByName(running_totals(df.where(_slot(keys).isin(hot)), keys, bucket, order, totals))
    ranges = {f"__{name}": expr for name, expr in bucket.items()}
    cells = keys + list(ranges)
    inside = W.partitionBy(*cells).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = df.withColumns(ranges).withColumns({f"__v_{n}": e for n, e in totals.items()})
    local = marked.withColumns({f"__in_{n}": F.sum(f"__v_{n}").over(inside) for n in totals})
    sums = marked.groupBy(*cells).agg(*[F.sum(f"__v_{n}").alias(f"__cell_{n}") for n in totals])
    spec = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    before = spec.orderBy(*ranges).rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(
        *cells,
        *[F.coalesce(F.sum(f"__cell_{n}").over(before), F.lit(0)).alias(f"__pre_{n}") for n in totals],
    )
    joined = _rejoin(local, carried, cells)
    return joined.select(
        *[c for c in df.columns if c not in totals],
        *[(F.col(f"__in_{n}") + F.col(f"__pre_{n}")).alias(n) for n in totals],
    )


def running_count(df, keys, bucket, order, name: str, hot: list[int] | None = None) -> DataFrame:
    """Gap-free numbering from 1 within each key."""
    return running_totals(df, keys, bucket, order, {name: F.lit(1).cast("long")}, hot)


def running_last(
    df: DataFrame, keys: list[str], bucket: dict[str, Column], order: list, value: Column, name: str
) -> DataFrame:
    """Adds the last non-null ``value`` at or before the row."""
    ranges = {f"__{n}": expr for n, expr in bucket.items()}
    cells = keys + list(ranges)
    inside = W.partitionBy(*cells).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = df.withColumns(ranges).withColumn("__v", value)
    local = marked.withColumn("__in", F.last("__v", ignorenulls=True).over(inside))
    place = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    ends = marked.where(F.col("__v").isNotNull()).groupBy(*cells).agg(F.max_by("__v", place).alias("__end"))
    cells_seen = marked.select(*cells).distinct().join(ends, cells, "left")
    before = W.partitionBy(*keys).orderBy(*ranges).rowsBetween(W.unboundedPreceding, -1)
    carried = cells_seen.select(*cells, F.last("__end", ignorenulls=True).over(before).alias("__pre"))
    joined = _rejoin(local, carried, cells)
    return joined.select(
        *[c for c in df.columns if c != name], F.coalesce("__in", "__pre").alias(name)
    )


def _rejoin(local: DataFrame, carried: DataFrame, cells: list[str]) -> DataFrame:
    left, right = local.alias("__l"), carried.alias("__r")
    on = [F.col(f"__l.{c}").eqNullSafe(F.col(f"__r.{c}")) for c in cells]
    kept = [F.col(f"__l.{c}") for c in local.columns]
    return left.join(right, on).select(*kept, *[F.col(f"__r.{c}") for c in carried.columns if c not in cells])


def running_previous(
    df: DataFrame, keys: list[str], bucket: dict[str, Column], order: list, value: Column, name: str
) -> DataFrame:
    """Adds ``value`` of the row before, in order; null for the first row of a key."""
    ranges = {f"__{n}": expr for n, expr in bucket.items()}
    cells = keys + list(ranges)
    inside = W.partitionBy(*cells).orderBy(*order)
    marked = df.withColumns(ranges).withColumn("__v", F.struct(value.alias("v")))
    local = marked.withColumn("__in", F.lag("__v").over(inside))
    place = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    ends = marked.groupBy(*cells).agg(F.max_by("__v", place).alias("__end"))
    before = W.partitionBy(*keys).orderBy(*ranges)
    carried = ends.select(*cells, F.lag("__end").over(before).alias("__pre"))
    joined = _rejoin(local, carried, cells)
    return joined.select(*df.columns, F.coalesce("__in", "__pre")["v"].alias(name))


def left_join_spread(left: DataFrame, right: DataFrame, key: str, pieces: int = 1024) -> DataFrame:
    """Left join on ``key`` in which rows without a key are dealt over ``pieces`` places, not to one."""
    place = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*left.columns), F.lit(pieces))).otherwise(F.lit(0))
    known = right.withColumn("__place", F.lit(0).cast("bigint"))
    return left.withColumn("__place", place.cast("bigint")).join(known, [key, "__place"], "left").drop("__place")
