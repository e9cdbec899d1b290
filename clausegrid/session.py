"""Session settings the library expects, and the lineage cut it uses."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "clausegrid", master: str | None = None, **extra: str) -> SparkSession:
    """A session for local use and tests; on a cluster the submitted session is used as it is."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _base_folder(spark: SparkSession) -> str:
    """The folder all executors share. Only a session on one machine may do without a set one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is not None:
        return base.rstrip("/")
    # A master that cannot be read is not this machine.
    if spark.conf.get("spark.master", "").split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder the cluster names in ``spark.checkpoint.dir``."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(_base_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for written state in the shared folder."""
    return f"{_base_folder(spark)}/{purpose}-{uuid.uuid4().hex}"
