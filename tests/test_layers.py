"""Tables behind a manifest: whole states only, bounded reading, restarts."""

import pytest
from pyspark.sql import functions as F

from clausegrid.sources import jsonl, layers
from clausegrid.streaming import ingest, trace

TURNS = "role string, version string, n long"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_replacement_is_seen_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "turns")
    first = spark.createDataFrame([("user", "first", i) for i in range(50)] + [("tool", "first", 1), (None, "first", 2)], TURNS)
    second = spark.createDataFrame([("user", "second", i) for i in range(30)], TURNS)
    jsonl.replace_by_key(first, path, "role")
    before = rows(layers.read(spark, path).select("role", "version", "n").na.fill("-"))
    assert len(before) == 52

    def broken(*args):
        raise OSError("the writer was lost here")

    with monkeypatch.context() as m:
        m.setattr(layers, "publish", broken)
        with pytest.raises(OSError):
            jsonl.replace_by_key(second, path, "role")
    assert rows(layers.read(spark, path).select("role", "version", "n").na.fill("-")) == before
    # A reader that opened the old state keeps it while the new one is published.
    opened = layers.read(spark, path).select("role", "version", "n")
    for _ in range(2):
        jsonl.replace_by_key(second, path, "role")
    assert opened.where("version = 'first'").count() == 52
    now = layers.read(spark, path).select("version", "role", "n")
    assert now.where("role = 'user'").groupBy("version").count().collect()[0].asDict() == {"version": "second", "count": 30}
    assert now.where("role IS NULL OR role = 'tool'").count() == 2
    assert layers.vacuum(spark, path, keep=1) == 2
    assert rows(layers.read(spark, path).select("version", "role", "n").na.fill("-")) == rows(now.na.fill("-"))


def test_two_writers_do_not_lose_an_update(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", "x", 1)], TURNS)
    jsonl.replace_by_key(df, path, "role")
    version, entries = layers.state(spark, path)
    jsonl.replace_by_key(df, path, "role")
    with pytest.raises(layers.Conflict):
        layers.publish(spark, path, version, entries)


def test_reading_is_bounded_by_live_rows(spark, tmp_path):
    path = str(tmp_path / "steps")
    schema = "run_id long, seq long, node string, status string, id long"
    write = trace.keep_latest(path, ["id"])
    want = {}
    for batch in range(12):
        new = [(r, s, "n", "OK" if (r + batch) % 7 else "LOST", batch * 1000 + r * 10 + s) for r in range(batch % 5 + 3) for s in range(4)]
        write(spark.createDataFrame(new, schema), batch)
        want |= {(r, s): i for r, s, _, status, i in new if status != "LOST"}
        if batch % 4 == 3:
            before = layers.state(spark, path)
            write(spark.createDataFrame(new, schema), batch)  # the same batch again, after a restart
            assert layers.state(spark, path) == before
        counts = [e["rows"] for e in layers.state(spark, path)[1]]
        assert sum(counts) <= 1.5 * max(counts) and max(counts) <= len(want)
    assert {(r.run_id, r.seq): r.id for r in trace.latest_steps(spark, path, ["id"]).collect()} == want
    live = rows(trace.latest_steps(spark, path, ["id"]))
    layers.vacuum(spark, path, keep=1)
    assert rows(trace.latest_steps(spark, path, ["id"])) == live


def test_ingestion_conflicts_across_batches_and_restarts(spark, tmp_path):
    store, outcomes = str(tmp_path / "store"), str(tmp_path / "outcomes")
    schema = "batch_order long, checksum string, circular_number string, has_text boolean"
    write = ingest.ingest_batch(store, outcomes)
    batches = [
        [(1, "a", "1", True), (2, "a", "2", True), (3, "b", "1", True), (4, "c", "3", False)],
        [(5, "c", "3", True), (6, "b", "9", True), (7, "x", "1", True), (8, "a", "8", True), (9, None, "7", True)],
        [(10, "b", "10", True), (11, "y", "9", True), (12, "z", "2", True)],
    ]
    for i, batch in enumerate(batches):
        for _ in range(2 if i == 1 else 1):
            write(spark.createDataFrame(batch, schema), i)
    got = {r.batch_order: r.outcome for r in spark.read.parquet(outcomes).collect()}
    assert got == {1: "ingested", 2: "skipped", 3: "conflict", 4: "failed", 5: "ingested", 6: "ingested", 7: "conflict", 8: "skipped", 9: "ingested",
                   10: "skipped", 11: "conflict", 12: "ingested"}


def test_ingestion_that_fails_before_the_store_shows_its_keys(spark, tmp_path, monkeypatch):
    store, outcomes = str(tmp_path / "store"), str(tmp_path / "outcomes")
    schema = "batch_order long, checksum string, circular_number string, has_text boolean"
    batch = spark.createDataFrame([(1, "a", "1", True)], schema)
    write = ingest.ingest_batch(store, outcomes)
    with monkeypatch.context() as m:
        m.setattr(layers, "publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            write(batch, 0)
    assert layers.read(spark, store, ingest.STORE).count() == 0
    write(batch, 0)
    assert [r.outcome for r in spark.read.parquet(outcomes).collect()] == ["ingested"]


def test_a_batch_opens_only_the_buckets_it_hits(spark, tmp_path):
    store = str(tmp_path / "store")
    many = spark.range(2000).select(F.concat(F.lit("s"), "id").alias("checksum"), F.concat(F.lit("n"), "id").alias("circular_number"))
    layers.add(ingest.stored_keys(many, 0), store, 0, ingest.merged, ["bucket"])
    one = spark.createDataFrame([(1, "s7", "new", True)], "batch_order long, checksum string, circular_number string, has_text boolean")
    found = ingest.held(one, store, 1)
    assert [tuple(r) for r in found.collect()] == [("s7", None)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
