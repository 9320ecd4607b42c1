"""Streams over files, each read to its end."""

import pytest
from pyspark.sql import functions as F

from tideline.streaming import grace, recording


@pytest.fixture
def stream(spark, tmp_path):
    """Runs a stream over batches of (key, milliseconds, kind), one file each, and gives what came out."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run(make, key, *batches):
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, f"{key} string, ts_ms long, kind string").withColumn("ts", F.timestamp_millis("ts_ms")).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
        read = spark.readStream.schema(f"{key} string, ts_ms long, kind string, ts timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = make(read).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(240)
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    return run


def test_grace_keeps_a_session_over_a_short_stop(stream):
    first = [("a", 10, "Started"), ("a", 1000, "Stopped"), ("a", 3000, "Started"), ("a", 9000, "Stopped"), ("a", 9500, "Stopped"), ("b", 100, "Started"), ("b", 700, "Interrupt")]
    out = stream(lambda s: grace.grace_stream(s, 5000), "key", first, [("c", 60_000, "Started")], [("c", 120_000, "Started")])
    assert out == [("a", 10, 9000, "stopped"), ("b", 100, 700, "interrupt")]


def test_a_recorder_begins_ends_and_gives_up(stream):
    first = [("a", 10, "Started"), ("a", 500, "Ready"), ("a", 9000, "Stopped"), ("b", 10, "Started"), ("b", 300, "Stopped"), ("c", 10, "Started"), ("d", 10, "Interrupt"), ("d", 20, "Started")]
    out = stream(lambda s: recording.recorder_stream(s, 3, 1000), "device", first, [("z", 60_000, "Idle")], [("z", 120_000, "Idle")])
    assert [(d, e) for d, _, e in out] == [("a", "began"), ("a", "ended"), ("b", "abandoned"), ("c", "abandoned")]


def test_a_track_is_written_in_whole_commits(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "in"))
    read = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    recording.track_sink(read, str(tmp_path / "out"), str(tmp_path / "c"), once=True).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100
