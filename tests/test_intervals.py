"""Interval joins against brute force over all pairs, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import intervals, segments


def brute_attribution(segs, turns):
    out = {}
    for k, n, s, e in segs:
        mine = [(c, a, b) for q, c, a, b in turns if q == k]
        if not mine:
            out[k, n] = (None, None, None)
            continue
        o, g = {}, {}
        for c, a, b in mine:
            o[c] = o.get(c, 0) + max(0, min(e, b) - max(s, a))
            g[c] = min(g.get(c, 10**9), max(a - e, s - b, 0))
        best = min(o, key=lambda c: (-o[c], 0 if o[c] > 0 else g[c], c))
        out[k, n] = (best, o[best], 0 if o[best] > 0 else g[best])
    return out


def test_attribution_equals_brute_force(spark):
    rng = random.Random(1)
    turns = [(k, rng.randrange(4), a, a + rng.choice([0, 1, 5, 40, 3000])) for k in "ab" for a in (rng.randrange(4000) for _ in range(60))]
    segs = [(k, n, a, a + rng.choice([0, 3, 50, 900])) for k in "abc" for n, a in enumerate(rng.randrange(8000) for _ in range(40))]
    s = spark.createDataFrame(segs, "k string, seq int, start_s long, end_s long")
    t = spark.createDataFrame(turns, "k string, cluster int, start_s long, end_s long")
    got = {(r.k, r.seq): (r.cluster, r.overlap_s, r.gap_s) for r in intervals.overlap_attribution(s, t, ["k"], width=64).collect()}
    assert got == brute_attribution(segs, turns)
    assert intervals.overlap_attribution(s.limit(0), t, ["k"]).count() == 0
    assert {r.cluster for r in intervals.overlap_attribution(s, t.limit(0), ["k"]).collect()} == {None}
    null = spark.createDataFrame([("a", 0, None, 5), (None, 1, 1, 2)], s.schema)
    assert [r.cluster for r in intervals.overlap_attribution(null, t, ["k"]).orderBy("seq").collect()] == [None, None]


def test_slots_that_are_heard_at_once(spark):
    rng = random.Random(2)
    turns = [(k, rng.randrange(5), a, a + rng.choice([0, 2, 30, 500])) for k in "ab" for a in (rng.randrange(3000) for _ in range(40))]
    got = {tuple(r) for r in intervals.overlapping_slots(spark.createDataFrame(turns, "k string, slot int, start_s long, end_s long"), ["k"], width=32).collect()}
    want = {(k, c, d) for k, c, a, b in turns for q, d, x, y in turns if k == q and c != d and a < b and x < y and a < y and x < b}
    assert got == want and want


def test_nearest_turns_equal_brute_force(spark):
    rng = random.Random(3)
    turns = [(k, n, float(a), float(a + rng.choice([0, 2, 9]))) for k in "ab" for n, a in enumerate(rng.randrange(400) for _ in range(25))]
    at = [(k, x) for k in "ab" for x in range(0, 420, 7)]
    got = {(r.conv, r.at_s): (r.gap_s, r.seq) for r in intervals.nearest_turn(spark.createDataFrame(turns, "conv string, seq int, start_s double, end_s double"), spark.createDataFrame(at, "conv string, at_s long"), "conv").collect()}
    gap = lambda a, b, x: a - x if x < a else max(x - b, 0.0)
    assert got == {(k, x): min((gap(a, b, x), n) for q, n, a, b in turns if q == k) for k, x in at}


def test_loops_of_every_script_and_their_collapse(spark):
    said = [("a", i, t) for i, t in enumerate(["はい", "いいえ", "そう", "なに", "うん", "Да, да!", "да  да", "ДА\tДА", "да да", "да да.", "x"])]
    rows = spark.createDataFrame(said, "k string, n int, text string").withColumn("s", F.col("n") * 1.0).withColumn("e", F.col("n") + 0.5)
    assert [(r["first"], r["last"], r["n"], r["plain"]) for r in segments.loops(rows, ["k"], "n", "text").collect()] == [(5, 9, 5, "да да")]
    got = segments.collapsed_loops(rows, ["k"], "n", "s", "e", "text").orderBy("n").collect()
    assert [(r.text, r.s, r.e) for r in got if r.text.startswith("Да")] == [("Да, да!", 5.0, 9.5)] and len(got) == 7


@pytest.mark.parametrize("size", [None, 9.0])
def test_pieces_of_a_splice_never_overlap(spark, size):
    r = spark.createDataFrame([("a", 0.0, 5.0), ("a", 4.0, 6.0), ("a", 4.5, 4.6), ("a", 8.0, 12.0)], "k string, start_s double, end_s double").withColumn("size", F.lit(size))
    got = [(x.piece_start_s, x.piece_end_s) for x in segments.splice(r, ["k"], 0.5, 1.0, "size" if size else None).orderBy("spliced_s").collect()]
    assert got == [(0.0, 4.0), (4.0, 4.5), (4.5, 5.1), (8.0, size or 12.0)]


def test_a_session_without_speaker_audio_is_not_built(spark):
    import pytest

    from tideline.operators import intervals

    pieces = spark.createDataFrame([("a", "speaker", 1, 2.0), ("a", "speaker", 2, 1.0), ("b", "mic", 1, 1.0), ("c", "speaker", 1, 1.0)], "session string, track string, n int, size double")
    built = intervals.built_tracks(spark.createDataFrame([("a",), ("a",)], "session string"), pieces, "n", "size").collect()
    assert sorted(map(tuple, built), key=str) == [("a", "mic", None, 0.0, 1.0, True), ("a", "speaker", 1, 0.0, 2.0, False), ("a", "speaker", 2, 2.5, 1.0, False)]
    with pytest.raises(Exception, match="no audio for session b"):
        intervals.built_tracks(spark.createDataFrame([("b",)], "session string"), pieces, "n", "size").collect()
