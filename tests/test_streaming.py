from __future__ import annotations

import uuid

import pytest
from conftest import at
from pyspark.sql import functions as F

from lodestream.streaming import monitors

SCHEMA = "k string, t timestamp, v double"
ROWS = [("a" if i % 3 else "b", at(i * 70), 10.0 + (i * 7) % 13) for i in range(120)]


@pytest.fixture
def feed(spark, tmp_path):
    """Three files, read one a micro-batch."""
    for i in range(3):
        spark.createDataFrame(ROWS[i * 40 : i * 40 + 40], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))


def drain(df, tmp_path, mode):
    name = f"q{uuid.uuid4().hex}"
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.table(name).collect()


def test_tumbling_counts_equal_the_batch(spark, feed, tmp_path):
    got = {(r.k, r.start): r.n for r in drain(monitors.windowed(feed, "t", ["k"], "10 minutes", "1 day"), tmp_path, "complete")}
    batch = spark.createDataFrame(ROWS, SCHEMA).groupBy("k", F.window("t", "10 minutes").alias("w")).count()
    assert got == {(r.k, r.w.start): r["count"] for r in batch.collect()}


def test_sessions_equal_the_batch(spark, feed, tmp_path):
    got = {(r.k, r.start): r.events for r in drain(monitors.sessions(feed, "t", ["k"], "2 minutes", "1 day"), tmp_path, "complete")}
    batch = spark.createDataFrame(ROWS, SCHEMA).groupBy("k", F.session_window("t", "2 minutes").alias("w")).count()
    assert got == {(r.k, r.w.start): r["count"] for r in batch.collect()}


def test_snapshot_state_equals_one_pass(spark, feed, tmp_path):
    got = {(r.key, r["at"]): (r.change, r.mean, r.variation) for r in drain(monitors.snapshots(feed, "k", "t", "v"), tmp_path, "append")}
    want, history = {}, {"a": [], "b": []}
    for k, t, v in ROWS:
        want[(k, t)] = monitors.enrich(history[k], v)
        history[k].append(v)
    assert got == want


def test_flags_are_merged_and_a_rerun_changes_nothing(spark, tmp_path):
    merge = monitors.merge_flags(str(tmp_path / "flags"), ["k"])
    batches = [spark.createDataFrame(rows, "k string, flagged long, worst double") for rows in ([("a", 1, 2.0), ("a", 2, 5.0)], [("a", 3, 1.0), ("b", 1, 1.0)])]
    for number in (0, 1, 1):
        merge(batches[number], number)
    table = lambda: sorted(map(tuple, monitors.flags(spark, str(tmp_path / "flags")).collect()))
    assert table() == [("a", 6, 5.0, 3), ("b", 1, 1.0, 1)]
    for number in (2, 3, 4):
        merge(spark.createDataFrame([("a", 1, 9.0)], "k string, flagged long, worst double"), number)
    assert table() == [("a", 9, 9.0, 6), ("b", 1, 1.0, 1)]
    # A batch touches its own bucket only, and two versions of it are kept.
    assert sorted(map(len, monitors._versions(spark, str(tmp_path / "flags")).values())) == [1, 2]


def test_levels(spark):
    df = spark.createDataFrame([(1, 5.0, None), (2, 35.0, 0.1), (3, 16.0, 0.9)], "i int, change double, variation double")
    got = {r.i: r.level for r in monitors.levels(df, {"change": (15, 30, 40), "variation": (0.4, 0.6, 0.75)}).collect()}
    assert got == {1: None, 2: "warning", 3: "critical"}
