"""Following run traces: changed steps, latest state, terminal runs, budgets.

Each stream has a batch twin over the same rows, which is also what a finished log is read with.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from clausegrid.functions import fixed as K
from clausegrid.functions.scan import running_previous
from clausegrid.sources import layers

#: Seconds without a row after which the state of a run is forgotten, ended or not.
IDLE_SECONDS = 7 * 24 * 3600


def use_state_store(spark: SparkSession) -> None:
    """State with several variables, timers and time-to-live needs the RocksDB state store."""
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)


def fingerprint(columns: list[str]) -> Column:
    """What has to differ for a step to be sent again."""
    return F.md5(F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns]))


# --- changed steps ------------------------------------------------------------------------


def trace_changes(log: DataFrame, watched: list[str], bucket: dict[str, Column], order: list[str]) -> DataFrame:
    """Rows of a finished log that were new or changed when they arrived, per (run_id, seq)."""
    marked = log.withColumn("__print", fingerprint(watched))
    before = running_previous(marked, ["run_id", "seq"], bucket, order, F.col("__print"), "__before")
    changed = ~F.col("__print").eqNullSafe(F.col("__before"))
    return before.where(changed).select(*log.columns)


class _Changes(StatefulProcessor):
    """Map state: the last fingerprint of each step of a run; value state: when the run ended.

    A run's state goes one limit after its terminal row, by a timer, and at the latest when a step has not been
    written for the time-to-live.
    """

    def __init__(self, columns: list[str], order: list[str], status: str | None, limit_ms: int, ttl_ms: int):
        self.columns, self.order, self.status = columns, order, status
        self.limit, self.ttl = limit_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.prints = handle.getMapState("prints", "seq string", "print string", self.ttl)
        self.ended = handle.getValueState("ended", "at long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        steps = pd.concat(list(rows), ignore_index=True)
        # Computed columns come without their names, but in order.
        steps = steps.set_axis([*self.columns, "__print", "__seq"], axis=1).sort_values(self.order, kind="stable")
        known = {seq: value for (seq,), (value,) in self.prints.iterator()}
        before = steps.groupby("__seq")["__print"].shift()
        first = before.isna()
        before[first] = steps.loc[first, "__seq"].map(known)
        for seq, value in steps.groupby("__seq")["__print"].last().items():
            if known.get(seq) != value:
                self.prints.updateValue((seq,), (value,))
        if self.status and not self.ended.exists() and steps[self.status].isin(K.TERMINAL_STATUSES).any():
            now = timerValues.getCurrentProcessingTimeInMs()
            self.ended.update((now,))
            self.handle.registerTimer(now + self.limit)
        yield steps.loc[steps["__print"] != before, self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.prints.clear()
        self.ended.clear()
        return iter([])


def trace_changes_stream(
    steps: DataFrame,
    watched: list[str],
    order: list[str],
    status: str | None = "status",
    limit_seconds: int = K.TRACE_TIMEOUT_SECONDS,
    ttl_seconds: int = IDLE_SECONDS,
) -> DataFrame:
    """The same on a stream: a fingerprint of state per step, forgotten after the run's end or long silence.

    ``status`` names the column whose terminal values end a run (None: there is none). A run's rows of one micro-batch
    are sorted together; the source's limits on a batch bound them.
    """
    use_state_store(steps.sparkSession)
    marked = steps.withColumns({"__print": fingerprint(watched), "__seq": F.coalesce(F.col("seq").cast("string"), F.lit(""))})
    processor = _Changes(steps.columns, order, status, limit_seconds * 1000, ttl_seconds * 1000)
    return marked.groupBy("run_id").transformWithStateInPandas(processor, steps.schema, "Append", "ProcessingTime")


# --- latest state -------------------------------------------------------------------------


def well_formed(step: DataFrame) -> Column:
    return (
        F.col("seq").isNotNull()
        & F.col("node").isNotNull()
        & F.coalesce(F.col("status").isin(*K.STEP_STATUSES), F.lit(False))
    )


def trace_reduce(log: DataFrame, arrival: list[str]) -> DataFrame:
    """Latest row per (run_id, seq); replaying rows changes nothing, malformed ones are left out."""
    rest = [c for c in log.columns if c not in ("run_id", "seq")]
    kept = log.where(well_formed(log))
    latest = kept.groupBy("run_id", "seq").agg(F.max_by(F.struct(*rest), F.struct(*arrival)).alias("row"))
    return latest.select("run_id", "seq", *[F.col(f"row.{c}").alias(c) for c in rest])


def malformed_count(log: DataFrame) -> DataFrame:
    return log.groupBy("run_id").agg(F.count_if(~well_formed(log)).alias("malformed"))


def keep_latest(path: str, arrival: list[str]):
    """``foreachBatch`` writer: the latest rows of each batch join a layered store, which merges as it grows.

    A batch that is run again after a failure is already in the store, or not at all.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        layers.add(trace_reduce(batch, arrival), path, batch_id, lambda rows: trace_reduce(rows, arrival))

    return write


def latest_steps(spark: SparkSession, path: str, arrival: list[str]) -> DataFrame:
    return trace_reduce(layers.read(spark, path), arrival)


def steps_after(steps: DataFrame, after: int) -> DataFrame:
    """Steps numbered beyond ``after``: a poll that reads only what is new."""
    return steps.where(F.col("seq") > after)


# --- the end of a trace --------------------------------------------------------------------


def trace_terminal(log: DataFrame, timeout_seconds: int = K.TRACE_TIMEOUT_SECONDS) -> DataFrame:
    """Per run of a finished log: ``done`` with its first terminal status, or ``timeout``.

    Rows: run_id, status, at. A run times out when no terminal status came within the limit of
    its first row.
    """
    ended = F.col("status").isin(*K.TERMINAL_STATUSES)
    runs = log.groupBy("run_id").agg(
        F.min("at").alias("started"), F.min(F.when(ended, F.struct("at", "status"))).alias("end")
    )
    in_time = F.coalesce(
        F.unix_micros("end.at") - F.unix_micros("started") <= timeout_seconds * 1_000_000, F.lit(False)
    )
    return runs.select(
        "run_id", F.when(in_time, "done").otherwise("timeout").alias("event"), F.when(in_time, F.col("end.status")).alias("status")
    )


class _Ends(StatefulProcessor):
    """Value state: when the run's timer goes off, and whether the run has been reported."""

    def __init__(self, run_id: str, limit_ms: int, ttl_ms: int):
        self.run_id, self.limit, self.ttl = run_id, limit_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "at long")
        self.reported = handle.getValueState("reported", "at long", self.ttl)

    def _found(self, key, now: int, event: str, status: str | None) -> pd.DataFrame:
        if self.until.exists():
            self.handle.deleteTimer(self.until.get()[0])
            self.until.clear()
        self.reported.update((now,))
        return pd.DataFrame({self.run_id: [key[0]], "event": [event], "status": [status]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ends = [batch.loc[batch["status"].isin(K.TERMINAL_STATUSES), ["at", "status"]] for batch in rows]
        if self.reported.exists():
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        hits = pd.concat(ends).sort_values("at", kind="stable")
        if len(hits):
            yield self._found(key, now, "done", hits["status"].iloc[0])
        elif not self.until.exists():
            self.until.update((now + self.limit,))
            self.handle.registerTimer(now + self.limit)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        yield self._found(key, timerValues.getCurrentProcessingTimeInMs(), "timeout", None)


def trace_terminal_stream(
    log: DataFrame, timeout_seconds: int = K.TRACE_TIMEOUT_SECONDS, ttl_seconds: int = IDLE_SECONDS
) -> DataFrame:
    """The same on a stream with a processing-time timer per run; a run is reported once.

    The timer runs from a run's first row, whatever rows follow, and is taken back when the run ends. That a run has
    been reported is remembered for ``ttl_seconds``.
    """
    use_state_store(log.sparkSession)
    run_type = log.schema["run_id"].dataType.simpleString()
    return log.groupBy("run_id").transformWithStateInPandas(
        _Ends("run_id", timeout_seconds * 1000, ttl_seconds * 1000), f"run_id {run_type}, event string, status string", "Append", "ProcessingTime"
    )


# --- budgets -------------------------------------------------------------------------------


class _Spending(StatefulProcessor):
    """Value state: what a run has spent; it goes when the run has made no call for the time-to-live."""

    def __init__(self, order: list[str], max_calls: int, max_tokens: int, ttl_ms: int):
        self.order, self.max_calls, self.max_tokens, self.ttl = order, max_calls, max_tokens, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.spent = handle.getValueState("spent", "calls long, tokens long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, t = self.spent.get() if self.spent.exists() else (0, 0)
        calls = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable").reset_index(drop=True)
        calls_before = n + pd.Series(range(len(calls)), dtype="int64")
        tokens_before = t + calls["tokens"].cumsum() - calls["tokens"]
        self.spent.update((int(n + len(calls)), int(t + calls["tokens"].sum())))
        yield pd.DataFrame(
            {
                "id": calls["id"],
                "run_id": calls["run_id"],
                "tokens": calls["tokens"],
                "calls_before": calls_before,
                "tokens_before": tokens_before,
                "refused": (calls_before >= self.max_calls) | (tokens_before >= self.max_tokens),
            }
        )


def budget_stream(
    calls: DataFrame,
    order: list[str],
    max_calls: int = K.MAX_ASSESSMENT_CALLS,
    max_tokens: int = K.MAX_ASSESSMENT_TOKENS,
    ttl_seconds: int = IDLE_SECONDS,
) -> DataFrame:
    """Calls (id, run_id, tokens) as they come, each with what its run had spent and whether it is refused.

    A run that makes no call for ``ttl_seconds`` is over: what it spent is forgotten.
    """
    use_state_store(calls.sparkSession)
    return calls.groupBy("run_id").transformWithStateInPandas(
        _Spending(order, max_calls, max_tokens, ttl_seconds * 1000),
        "id long, run_id long, tokens long, calls_before long, tokens_before long, refused boolean",
        "Append",
        "ProcessingTime",
    )
