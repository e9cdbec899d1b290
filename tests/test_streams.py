"""The run timer across batches of a stream."""

import datetime
import time

from clausegrid.streaming import trace

SCHEMA = "run_id long, status string, at timestamp"


def test_runs_time_out_whatever_rows_follow(spark, tmp_path):
    """A run that gets another row before its limit still times out; a finished one is reported once."""
    source, out = tmp_path / "in", []
    source.mkdir()
    at = datetime.datetime(2024, 1, 1)

    def write(name, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / name))
        for file in (tmp_path / name).glob("part-*.parquet"):
            file.rename(source / f"{name}.parquet")

    write("first", [(1, "RUNNING", at), (2, "RUNNING", at), (3, "COMPLETED", at), (3, "FAILED", at - datetime.timedelta(1))])
    log = spark.readStream.schema(SCHEMA).parquet(str(source))
    found = trace.trace_terminal_stream(log, 6)
    running = (
        found.writeStream.foreachBatch(lambda df, i: out.extend(map(tuple, df.collect())))
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(processingTime="1 second")
        .start()
    )
    try:
        deadline = time.time() + 60
        while not out and time.time() < deadline:
            time.sleep(0.5)
        write("second", [(1, "RUNNING", at), (3, "COMPLETED", at)])
        while len(out) < 3 and time.time() < deadline:
            time.sleep(0.5)
    finally:
        running.stop()
    assert sorted(out) == [(1, "timeout", None), (2, "timeout", None), (3, "done", "FAILED")]


def started(spark, tmp_path, schema, stream, out):
    """A running stream over a folder, and the function that adds a file to it."""
    source = tmp_path / "in"
    source.mkdir()

    def write(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
        for file in (tmp_path / name).glob("part-*.parquet"):
            file.rename(source / f"{name}.parquet")

    running = (
        stream(spark.readStream.schema(schema).parquet(str(source)))
        .writeStream.foreachBatch(lambda df, i: out.extend(map(tuple, df.collect())))
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(processingTime="1 second")
        .start()
    )
    return running, write


def wait_for(condition, seconds=60):
    deadline = time.time() + seconds
    while not condition() and time.time() < deadline:
        time.sleep(0.3)
    assert condition()


def state_rows(spark, tmp_path, variable):
    reader = spark.read.format("statestore").option("path", str(tmp_path / "checkpoint"))
    return reader.option("stateVarName", variable).load().collect()


def test_state_of_changes_ends_with_the_run(spark, tmp_path):
    """Three batches: changed steps only, and no state of a run once its limit after the terminal row is over."""
    schema, out = "id long, run_id long, seq long, node string, status string", []
    running, write = started(
        spark, tmp_path, schema, lambda log: trace.trace_changes_stream(log, ["node", "status"], ["id"], limit_seconds=4), out
    )
    try:
        write("first", [(1, 1, 1, "a", "OK"), (2, 1, 1, "a", "OK"), (3, 1, 2, "b", "OK"), (4, 2, None, "a", "OK"), (5, 2, None, "a", "OK")])
        wait_for(lambda: len(out) >= 3)
        assert sorted(r[0] for r in out) == [1, 3, 4]
        write("second", [(6, 1, 2, "b", "OK"), (7, 1, 1, "a", "ERROR"), (8, 1, 3, "c", "COMPLETED")])
        wait_for(lambda: len(out) >= 5)
        assert sorted(r[0] for r in out)[3:] == [7, 8]
        # After the limit the run is forgotten: the same step counts as new again.
        time.sleep(6)
        write("third", [(9, 1, 3, "c", "COMPLETED"), (10, 2, None, "a", "OK")])
        wait_for(lambda: len(out) >= 6)
        assert sorted(r[0] for r in out)[5:] == [9]
        time.sleep(7)
        write("fourth", [(11, 3, 1, "z", "OK")])
        wait_for(lambda: len(out) >= 7)
    finally:
        running.stop()
    assert {r.key.run_id for r in state_rows(spark, tmp_path, "prints")} == {2, 3}
    assert state_rows(spark, tmp_path, "ended") == []


def test_spending_is_forgotten_after_silence(spark, tmp_path):
    schema, out = "id long, run_id long, tokens long", []
    running, write = started(spark, tmp_path, schema, lambda calls: trace.budget_stream(calls, ["id"], 3, 100, ttl_seconds=20), out)
    try:
        write("first", [(1, 1, 60), (2, 1, 60), (3, 1, 1), (4, 2, 5)])
        wait_for(lambda: len(out) >= 4)
        write("second", [(5, 2, 7)])
        wait_for(lambda: len(out) >= 5)
        time.sleep(22)
        write("third", [(6, 1, 9), (7, 3, 1)])
        wait_for(lambda: len(out) >= 7)
    finally:
        running.stop()
    by_id = {r[0]: r[3:] for r in out}
    assert by_id == {1: (0, 0, False), 2: (1, 60, False), 3: (2, 120, True), 4: (0, 0, False), 5: (1, 5, False), 6: (0, 0, False), 7: (0, 0, False)}
    assert {r.key.run_id for r in state_rows(spark, tmp_path, "spent")} <= {1, 2, 3}
