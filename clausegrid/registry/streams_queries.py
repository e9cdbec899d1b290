"""Trace streams and their batch twins over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.plans.corpora import Corpora, pick
from clausegrid.registry.assessment_queries import _BUDGET, _CALLS, _TOKENS
from clausegrid.registry.core import query
from clausegrid.registry.sources_queries import _CLASSIFIED, incoming
from clausegrid.session import shared_folder
from clausegrid.streaming import trace as S
from clausegrid.streaming.ingest import stream_ingest


def _log(events: DataFrame) -> DataFrame:
    tokens = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("run_id"),
        (tokens % 10).alias("seq"),
        F.col("event_type").alias("node"),
        pick(F.col("event_type"), [("error", "ERROR"), ("signup", "RUNNING"), ("view", "LOST")], "OK").alias("status"),
        tokens.alias("tokens"),
    )


_LOG = """(SELECT event_id AS id, user_id AS run_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS seq, event_type AS node,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'RUNNING' WHEN 'view' THEN 'LOST' ELSE 'OK' END AS status,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens FROM events)"""
_CHANGES = f"""SELECT id, run_id, seq, node, status, tokens FROM (SELECT *, lag(node || status) OVER (PARTITION BY run_id, seq ORDER BY id) AS before FROM {_LOG})
WHERE before IS NULL OR before <> node || status"""


@query("trace_changes", _CHANGES)
def _(c: Corpora):
    return S.trace_changes(_log(c.events), ["node", "status"], {"range": F.expr("id div 4096")}, ["id"])


def _stream(c: Corpora) -> DataFrame:
    source = c.spark.readStream.schema(c.events.schema).option("pathGlobFilter", "events.parquet")
    return _log(source.parquet(c.folder))


def _finished(c: Corpora, stream: DataFrame, name: str) -> DataFrame:
    """Run the stream over everything there is and read back what it wrote.

    Without batches for timers alone: a stream that ends with its input has no rows to come.
    """
    folder = shared_folder(c.spark, name)
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = c.spark.conf.get(setting)
    c.spark.conf.set(setting, "false")
    try:
        running = (
            stream.writeStream.format("parquet")
            .option("path", f"{folder}/out")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
    finally:
        c.spark.conf.set(setting, before)
    running.awaitTermination()
    return c.spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("trace_changes_stream", _CHANGES)
def _(c: Corpora):
    return _finished(c, S.trace_changes_stream(_stream(c), ["node", "status"], ["id"]), "changes")


@query(
    "trace_reduce",
    f"""SELECT id, run_id, seq, node, status, tokens FROM (SELECT *, row_number() OVER (PARTITION BY run_id, seq ORDER BY id DESC) AS k FROM {_LOG} WHERE status <> 'LOST') WHERE k = 1""",
)
def _(c: Corpora):
    return S.trace_reduce(_log(c.events), ["id"])


@query(
    "trace_reduce_stream",
    f"""SELECT id, run_id, seq, node, status, tokens FROM (SELECT *, row_number() OVER (PARTITION BY run_id, seq ORDER BY id DESC) AS k FROM {_LOG} WHERE status <> 'LOST') WHERE k = 1""",
)
def _(c: Corpora):
    folder = shared_folder(c.spark, "latest")
    running = (
        _stream(c)
        .writeStream.foreachBatch(S.keep_latest(f"{folder}/out", ["id"]))
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return S.latest_steps(c.spark, f"{folder}/out", ["id"])


@query("malformed_count", f"SELECT run_id, count(*) FILTER (status = 'LOST') AS malformed FROM {_LOG} GROUP BY 1")
def _(c: Corpora):
    return S.malformed_count(_log(c.events))


@query("steps_after", f"SELECT * FROM {_LOG} WHERE seq > 6")
def _(c: Corpora):
    return S.steps_after(_log(c.events), 6)


@query(
    "trace_terminal",
    """SELECT run_id, CASE WHEN e - s <= 86400000000 THEN 'done' ELSE 'timeout' END AS event, CASE WHEN e - s <= 86400000000 THEN status END AS status
FROM (SELECT user_id AS run_id, epoch_us(min(ts)) AS s, coalesce(epoch_us(min(ts) FILTER (event_type IN ('error', 'purchase'))), 99999999999999999) AS e,
  arg_min(CASE event_type WHEN 'error' THEN 'FAILED' ELSE 'COMPLETED' END, ts) FILTER (event_type IN ('error', 'purchase')) AS status FROM events GROUP BY 1)""",
)
def _(c: Corpora):
    return S.trace_terminal(_statuses(c.events), 86400)


def _statuses(events: DataFrame) -> DataFrame:
    status = pick(F.col("event_type"), [("error", "FAILED"), ("purchase", "COMPLETED")], "RUNNING")
    return events.select(F.col("user_id").alias("run_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("at"))


@query(
    "trace_terminal_stream",
    """SELECT user_id AS run_id, 'done' AS event, arg_min(CASE event_type WHEN 'error' THEN 'FAILED' ELSE 'COMPLETED' END, ts) AS status
FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1""",
)
def _(c: Corpora):
    source = c.spark.readStream.schema(c.events.schema).option("pathGlobFilter", "events.parquet").parquet(c.folder)
    return _finished(c, S.trace_terminal_stream(_statuses(source), 86400), "terminal")


@query("stream_ingest", _CLASSIFIED.format(more="").replace("source = 'src3'", "false"))
def _(c: Corpora):
    """The documents as two batches of one stream that is stopped and started again, against an empty store."""
    folder = shared_folder(c.spark, "ingest")
    middle = c.documents.agg((F.max("doc_id") + F.min("doc_id")) / 2).first()[0]
    source = c.spark.readStream.schema(c.documents.schema).parquet(f"{folder}/in/*")
    for name, half in (("first", F.col("doc_id") <= middle), ("second", F.col("doc_id") > middle)):
        c.documents.where(half).write.parquet(f"{folder}/in/{name}")
        stream_ingest(incoming(source), f"{folder}/stored", f"{folder}/outcomes", f"{folder}/checkpoint").awaitTermination()
    return c.spark.read.parquet(f"{folder}/outcomes").select("batch_order", "outcome")


@query("stream_budget", _BUDGET)
def _(c: Corpora):
    calls = _stream(c).select("id", "run_id", "tokens")
    return _finished(c, S.budget_stream(calls, ["id"], _CALLS, _TOKENS), "budget")
