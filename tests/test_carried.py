"""The carried cache against a batch walk, and a recorder's times."""

import numpy as np
import pytest
from oracle import TABLES
from pyspark.sql import functions as F

from tideline.operators import cache
from tideline.plans import streams
from tideline.streaming import carried, recording, replay


def walk(rule, chunks):
    """Queue and cache after all chunks, by the rows' rules; which rows stay is asked of kept_rows, tested below."""
    queue, stored, last, compressed = [], [], -1, False
    for told in chunks:
        queue = [(f, told.get(f, p)) for f, p in queue] + [(f, told[f]) for f in sorted(told) if f > last]
        if not compressed:
            stored = [(f, told.get(f, p)) for f, p in stored]
        last = max(last, *told)
        if len(queue) > rule.queue:
            n = min(max(rule.at_least, len(queue) - rule.queue), len(queue))
            stored, queue = stored + queue[:n], queue[n:]
        if len(stored) > rule.capacity:
            stored = [(None, (0.0,) * rule.slots) if i is None else stored[i] for i in carried.kept_rows(np.array([p for _, p in stored]), rule)]
            compressed = True
    return [("cache", i, f, p) for i, (f, p) in enumerate(stored)] + [("queue", i, f, p) for i, (f, p) in enumerate(queue)]


def test_rows_that_stay_are_those_of_the_batch_operator(spark):
    rng = np.random.default_rng(2)
    rule = streams.RULE
    grids = [np.round(rng.random((n, 4)) ** (1 + k), 2) for k, n in enumerate((17, 22, 30, 22))] + [np.zeros((20, 4)), np.ones((20, 4))]
    rows = [(g, f, s, float(p)) for g, grid in enumerate(grids) for f, row in enumerate(grid) for s, p in enumerate(row)]
    kept = cache.compress(spark.createDataFrame(rows, "g int, frame int, slot int, p double"), ["g"], "frame", "slot", "p", rule.capacity, rule.least, rule.strong, rule.weak, rule.latest, rule.silence)
    want = {g: [] for g in range(len(grids))}
    for r in kept.orderBy("g", "position").collect():
        want[r["g"]].append(r["frame"])
    assert {g: carried.kept_rows(grid, rule) for g, grid in enumerate(grids)} == want


def test_cache_carried_over_chunks_and_restarts_equals_a_batch_walk(spark):
    sessions = {}
    for r in streams.cache_chunks(spark, TABLES).collect():
        sessions.setdefault(r["session"], {}).setdefault(r["chunk"], {})[r["frame"]] = tuple(r["probs"])
    want = {s: walk(streams.RULE, [chunks[c] for c in sorted(chunks)]) for s, chunks in sessions.items()}
    got = {}
    for r in streams.carried_cache(spark, TABLES).orderBy("part", "position").collect():
        got.setdefault(r["session"], []).append((r["part"], r["position"], r["frame"], tuple(r["probs"])))
    rounded = {s: [(a, i, f, tuple(round(x, 6) for x in p)) for a, i, f, p in rows] for s, rows in want.items()}
    assert got == rounded and any(f is None for rows in got.values() for _, _, f, _ in rows)


@pytest.mark.parametrize(("tries", "wait", "at"), [(5, 2000, 10_000), (1, 700, 700)])
def test_an_abandoned_session_tells_when_its_last_try_was_due(spark, tries, wait, at):
    """Whether the next event comes long after, in the same batch or another, or never."""
    made = lambda rows: spark.createDataFrame(rows, "device string, ts_ms long, kind string").withColumn("ts_ms", F.col("ts_ms") + 5000).withColumn("ts", F.timestamp_millis("ts_ms"))
    parts = [made([("a", 0, "Started"), ("a", 100_000, "Idle"), ("b", 0, "Started"), ("c", 0, "Started"), ("c", at - 1, "Ready")]), made([("b", 200_000, "Idle")]), made([("z", 10**9, "Tick")]), made([("z", 2 * 10**9, "Tick")])]
    got = replay.replayed(parts, lambda s: recording.recorder_stream(s, tries, wait))
    assert sorted((d, ms - 5000, e) for d, ms, e in got.collect()) == [("a", at, "abandoned"), ("b", at, "abandoned"), ("c", at - 1, "began")]
