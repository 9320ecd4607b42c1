"""Robust lines through the windows of tracks: against a plain walk, and the rows that tasks hold for them."""

import random
from itertools import chain

from tideline.operators import planning, stats


def upper(values):
    return sorted(values)[len(values) // 2] if values else None


def walked(points):
    each = [upper([(v - y) / (u - x) for u, v in points if u != x]) for x, y in points]
    slope = upper([s for s in each if s is not None])
    return None if slope is None else (slope, upper([y - slope * x for x, y in points]))


def test_lines_equal_a_plain_walk(spark):
    """Copies of a window, windows of one place, odd and even numbers of them, nulls and a track that has no line."""
    rng = random.Random(3)
    tracks = {k: [(float(rng.randrange(9)), float(rng.randrange(40))) for _ in range(k % 13 + 1)] * (1 + k % 3 // 2) for k in range(60)}
    tracks[60] = [(1.0, 2.0), (1.0, 3.0)]
    rows = list(chain.from_iterable(((k, x, y) for x, y in p) for k, p in tracks.items())) + [(0, None, 1.0), (0, 1.0, None), (61, None, None)]
    got = {r.k: (r.slope, r.intercept) for r in stats.repeated_median(spark.createDataFrame(rows, "k long, x double, y double"), ["k"], "x", "y").collect()}
    assert got == {k: w for k, p in tracks.items() if (w := walked(p))}


def test_pairs_of_windows_are_no_rows(spark):
    """400 windows have 159,600 slopes; no step of the plan has more rows than the windows."""
    rows = spark.range(400).selectExpr("id % 2 AS k", "id AS i", "2 * id + id % 5 AS lag")
    lines = stats.repeated_median(rows, ["k"], "i", "lag")
    assert "Join" not in lines._jdf.queryExecution().executedPlan().toString() and lines.count() == 2
    assert planning.steady_lags(rows, ["k"], "i", "lag", 2, 9).count() == 2
