"""Tables kept as folders named by a manifest: readers see one whole state or the next, never half of one.

Data are written beside the live folders; the new state becomes visible with one rename, that of a manifest
numbered one higher. A writer that fails before leaves folders no manifest names, which ``vacuum`` removes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A folder stays as it is while it has at least this many times the rows of all later ones together.
GROWTH = 2


class Conflict(RuntimeError):
    """Another writer published the same version first."""


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = lambda name="": hadoop.Path(f"{path}/{name}" if name else path)
    return where().getFileSystem(spark._jsc.hadoopConfiguration()), where


def _versions(spark: SparkSession, path: str) -> list[int]:
    system, where = _files(spark, path)
    if not system.exists(where("manifests")):
        return []
    names = [s.getPath().getName() for s in system.listStatus(where("manifests"))]
    return sorted(int(n) for n in names if n.isdigit())


def state(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[dict]]:
    """The newest (or given) version and its entries; version 0 has none."""
    versions = _versions(spark, path)
    if not versions:
        return 0, []
    version = versions[-1] if version is None else version
    system, where = _files(spark, path)
    stream = system.open(where(f"manifests/{version}"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return version, json.loads(text)


def publish(spark: SparkSession, path: str, version: int, entries: list[dict]) -> None:
    """Makes ``entries`` the state after ``version``, in one rename; a second writer of it gets ``Conflict``."""
    system, where = _files(spark, path)
    system.mkdirs(where("manifests"))
    draft, final = where(f"manifests/.draft-{uuid.uuid4().hex}"), where(f"manifests/{version + 1}")
    out = system.create(draft)
    try:
        out.write(json.dumps(entries).encode())
    finally:
        out.close()
    if system.exists(final) or not system.rename(draft, final):
        system.delete(draft, False)
        raise Conflict(f"version {version + 1} of {path} exists")


def write_folder(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Writes rows beside the live state; the name of the new folder."""
    name = f"data/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(f"{path}/{name}")
    return name


def read_entry(spark: SparkSession, path: str, entry: dict, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("basePath", f"{path}/{entry['folder']}")
    reader = reader.schema(schema) if schema else reader
    return reader.parquet(*(f"{path}/{entry['folder']}/{p}" for p in entry.get("parts", [""])))


def read(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """All rows of the live state as of now; rows added later are not seen. Without any, ``schema`` is needed."""
    entries = state(spark, path)[1]
    if not entries:
        return spark.createDataFrame([], schema)
    out = read_entry(spark, path, entries[0], schema)
    for entry in entries[1:]:
        out = out.unionByName(read_entry(spark, path, entry, schema))
    return out


def add(
    rows: DataFrame,
    path: str,
    batch: int,
    merge: Callable[[DataFrame], DataFrame],
    partition_by: list[str] | None = None,
) -> bool:
    """Adds a batch as a new folder and merges the newest folders while they are not much smaller than the one before.

    ``merge`` reduces the union of folders to what they say together. Afterwards every folder has ``GROWTH`` times the rows of
    all later ones, so all together hold at most one and a half times the rows of the oldest, and a row is
    rewritten a logarithmic number of times. A batch at or before the last one added is left alone (False).
    """
    spark = rows.sparkSession
    version, entries = state(spark, path)
    if entries and batch <= entries[-1]["batch"]:
        return False

    def written(df: DataFrame) -> dict:
        folder = write_folder(df, path, partition_by)
        return {"folder": folder, "batch": batch, "rows": spark.read.schema(df.schema).parquet(f"{path}/{folder}").count()}

    entries = [*entries, written(rows)]
    cut, later = len(entries) - 1, entries[-1]["rows"]
    while cut and entries[cut - 1]["rows"] < GROWTH * later:
        cut -= 1
        later += entries[cut]["rows"]
    if cut < len(entries) - 1:
        together = read_entry(spark, path, entries[cut], None)
        for entry in entries[cut + 1 :]:
            together = together.unionByName(read_entry(spark, path, entry, None))
        entries = [*entries[:cut], written(merge(together))]
    publish(spark, path, version, entries)
    return True


def replace_parts(df: DataFrame, path: str, key: str) -> None:
    """Rows of ``df`` take the place of all stored rows with the same values of ``key``; other keys stay.

    Readers see the state before or the state after. Written twice, the rows are there once.
    """
    spark = df.sparkSession
    version, entries = state(spark, path)
    folder = write_folder(df, path, [key])
    system, where = _files(spark, path)
    names = [s.getPath().getName() for s in system.listStatus(where(folder))]
    parts = sorted(n for n in names if n.startswith(f"{key}="))
    kept = [{**e, "parts": [p for p in e["parts"] if p not in set(parts)]} for e in entries]
    entries = [e for e in kept if e["parts"]] + ([{"folder": folder, "parts": parts}] if parts else [])
    publish(spark, path, version, entries)


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes manifests but the last ``keep`` and the folders that none of those names; the number of folders removed.

    Readers of older versions, and writers that have not published yet, must be done.
    """
    system, where = _files(spark, path)
    versions = _versions(spark, path)
    live = {e["folder"] for v in versions[-keep:] for e in state(spark, path, v)[1]}
    for v in versions[:-keep]:
        system.delete(where(f"manifests/{v}"), False)
    gone = 0
    if system.exists(where("data")):
        for s in system.listStatus(where("data")):
            if f"data/{s.getPath().getName()}" not in live:
                system.delete(s.getPath(), True)
                gone += 1
    return gone
