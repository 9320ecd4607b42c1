"""State of streams by groups of keys: how often Spark is asked, and that a group's keys don't meet."""

import pytest
from pyspark.sql import functions as F

from tideline.streaming import carried, grace, grouped, recording, replay

KEYS = 60


@pytest.fixture
def updates(monkeypatch):
    """State rows that the streams of a test update, over all their batches."""
    from pyspark.sql.streaming.query import StreamingQuery

    counted, wait = [], StreamingQuery.awaitTermination

    def waited(self, *args):
        done = wait(self, *args)
        counted.extend(o.numRowsUpdated for p in self.recentProgress for o in p.stateOperators)
        return done

    monkeypatch.setattr(StreamingQuery, "awaitTermination", waited)
    return counted


def events(spark, key, rows):
    return spark.createDataFrame(rows, f"{key} string, ts_ms long, kind string").withColumn("ts", F.timestamp_millis("ts_ms"))


def test_keys_of_a_group_keep_their_own_sessions_and_deadlines(spark):
    names = [None, *(f"k{i}" for i in range(1, KEYS))]
    first = [(k, i, "Started") for i, k in enumerate(names, 1)] + [(k, 1000 + i, "Stopped") for i, k in enumerate(names, 1)]
    # half of the keys go on in time, the others' deadlines pass one by one
    parts = [first, [(k, 5000 + i, "Started") for i, k in enumerate(names, 1) if i % 2 == 0], [("~", 10**9, "Tick")], [("~", 2 * 10**9, "Tick")]]
    got = replay.replayed([events(spark, "key", p) for p in parts], lambda s: grace.grace_stream(s, 5000, groups=3)).collect()
    assert {tuple(r) for r in got} == {(k, i, 1000 + i, "stopped") for i, k in enumerate(names, 1) if i % 2}


def test_groups_bound_the_state_rows_of_many_keys(spark, updates):
    rows = [(f"k{i}", i, "Started") for i in range(KEYS)]
    replay.replayed([events(spark, "key", rows)], lambda s: grace.grace_stream(s, 5000, groups=2))
    assert 0 < sum(updates) <= 4


def test_groups_bound_the_state_rows_of_many_recorders(spark, updates):
    rows = [(f"k{i}", i, "Started") for i in range(KEYS)]
    replay.replayed([events(spark, "device", rows)], lambda s: recording.recorder_stream(s, groups=2))
    assert 0 < sum(updates) <= 8  # a timer is a row, too, and is also found by its time


def test_groups_bound_the_state_rows_of_many_caches(spark, updates):
    frames = spark.createDataFrame([(i, 0, 0, [0.1, 0.9, 0.0, 0.2]) for i in range(KEYS)], "session long, chunk long, frame long, probs array<double>")
    got = replay.replayed([frames], lambda s: carried.cache_stream(s, carried.CacheRule(), 2))
    assert got.count() == KEYS and 0 < sum(updates) <= 4


def test_groups_grow_in_number_with_the_keys(spark):
    assert grouped.groups_for(spark.range(100), "id") == grouped.FEWEST
    assert grouped.groups_for(spark.range(0), "id") == grouped.FEWEST
    assert grouped.groups_for(spark.range(400_000), "id") in (512, 1024)
