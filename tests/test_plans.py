"""Plans, files and reports that SQL does not reach, on small cases worked out by hand."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from tideline.operators import names, planning, voices
from tideline.sources import reports


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_spans_take_close_regions_up_to_their_limit_and_split_long_ones(spark):
    regions = spark.createDataFrame([("a", 100, 150, 1000), ("a", 180, 200, 1000), ("b", 0, 250, 260)], "k string, start long, end long, size long")
    got = rows(planning.span_plan(regions, ["k"], 10, 30, 120), "k", "piece_start")
    assert got == [
        ("a", 0, 90, 210, 100, 150, True, True), ("a", 0, 90, 210, 180, 200, True, True),
        ("b", 0, 0, 110, 0, 100, True, False), ("b", 1, 90, 210, 100, 200, False, False), ("b", 2, 190, 260, 200, 250, False, True),
    ]
    assert planning.span_plan(regions.limit(0), ["k"], 10, 30, 120).count() == 0


def test_loud_windows_keep_their_distance_and_silence_is_none(spark):
    c = spark.createDataFrame([("a", 0, 5.0), ("a", 2, 9.0), ("a", 4, 9.0), ("a", 6, 5.0), ("a", 9, 0.0)], "k string, start long, energy double")
    assert rows(planning.loud_windows(c, ["k"], 4, 12), "start") == [("a", 2), ("a", 6)]
    assert rows(planning.loud_windows(c, ["k"], 4, 1), "start") == [("a", 2)]


def test_a_stray_window_does_not_move_the_lag_and_too_few_give_none(spark):
    points = [("a", t, 100 + t // 10) for t in (0, 10, 20, 30, 40)] + [("a", 50, 9000), ("b", 0, 1), ("b", 1, 1), ("c", 5, 1), ("c", 5, 2), ("c", 5, 3)]
    got = {r.k: r for r in planning.steady_lags(spark.createDataFrame(points, "k string, t long, lag long"), ["k"], "t", "lag", 2, 20).collect()}
    assert (got["a"].result, got["a"].lag, got["a"].windows, got["a"].spread) == ("measured", 102, 5, 0)
    assert got["b"].result == got["c"].result == "too_few_windows" and got["b"].lag is None


@pytest.mark.parametrize(("mic", "speaker", "want"), [(10, 3, (7e-9, 0.0)), (3, 10, (0.0, 7e-9)), (5, 5, (0.0, 0.0))])
def test_one_track_is_shifted_at_most(spark, mic, speaker, want):
    a, b = planning.track_offsets(*(F.lit(x).cast("long") for x in (mic, speaker, 1, 1)))
    assert tuple(spark.range(1).select(a, b).first()) == pytest.approx(want)


def test_ticks_are_cut_towards_zero_and_a_timebase_without_denominator_fails(spark):
    a, b = planning.track_offsets(*(F.lit(x).cast("long") for x in (0, 5, 1, 2)))
    assert tuple(spark.range(1).select(a, b).first()) == pytest.approx((0.0, 2e-9))
    a, _ = planning.track_offsets(F.col("id"), F.lit(5).cast("long"), F.lit(1).cast("long"), F.col("id") - F.col("id"))
    with pytest.raises(Exception, match="denominator 0"):
        spark.range(1).select(a).collect()


def test_a_profile_is_named_or_the_only_match(spark):
    s = spark.createDataFrame([(1, "x", "about y"), (2, "none", "y"), (3, None, "y and z"), (4, None, "just z"), (5, None, None)], "session int, explicit string, title string")
    p = spark.createDataFrame([("x", None, ["a"]), ("y", "y", ["b"]), ("z", "z", ["c"])], "profile string, match_title string, terms array<string>")
    got = rows(names.profile_match(s, p, F.array(F.lit("all"))), "session")
    assert got == [(1, "ok", "x", ["all", "a"]), (2, "unknown", None, None), (3, "several", None, None), (4, "ok", "z", ["all", "c"]), (5, "none", None, ["all"])]


def test_terms_are_dropped_from_the_first_that_does_not_fit(spark):
    t = spark.createDataFrame([(1, 1, " Ab "), (1, 2, "AB"), (1, 3, "a much longer one"), (1, 4, "c"), (2, 1, " ")], "k int, o int, t string")
    assert rows(names.vocabulary_prompt(t, ["k"], "o", "t", "T ", 10), "k") == [(1, "T Ab.", 2)]


def test_typed_names_are_enrolled_new_or_candidates(spark):
    n = spark.createDataFrame([("Alice Ray",), ("alina",), ("Bob",), ("bob",)], "name string")
    t = spark.createDataFrame([(1, " ALICE  ray"), (2, "ali"), (3, "bob"), (4, "Zoltan"), (5, "  "), (6, None)], "k int, typed string")
    got = rows(names.resolve_names(t, n, "k"), "k")
    assert got[0] == (1, "enrolled", "Alice Ray", None) and got[3] == (4, "new", "Zoltan", None)
    assert got[1] == (2, "candidates", None, ["alina", "Alice Ray"]) and got[2] == (3, "candidates", None, ["Bob", "bob"])
    assert [g[1] for g in got[4:]] == ["blank", "blank"]


def test_all_short_voices_are_asked_about_where_none_is_long(spark):
    v = [("a", 1, 0.0, 9.0, False, False, False), ("a", 2, 1.0, 2.0, False, False, False), ("a", 3, 2.0, 2.0, False, True, False), ("b", 1, 5.0, 2.0, False, False, False), ("b", 2, 1.0, 3.0, False, False, True), ("b", 3, 0.0, 3.0, True, False, False)]
    d = spark.createDataFrame(v, "s string, id int, first_s double, speech_s double, named boolean, tentative boolean, denied boolean")
    assert [(r.s, r.id) for r in voices.prompt_queue(d, ["s"]).orderBy("s", "place").collect()] == [("a", 1), ("b", 1)]
    assert voices.prompt_queue(d, ["s"], with_named=True, with_quiet=True).count() == 6


def turns(spark):
    return spark.createDataFrame([("s", 0, "Ann", 0.0, 1.0, "a & b"), ("s", 1, "Ann", 1.0, 1.0, "c"), ("s", 2, "Bo", 6000.0, 6001.5, None)], "session string, n int, speaker string, start_s double, end_s double, text string")


def test_transcripts_as_text_and_as_tables(spark, tmp_path):
    t = turns(spark)
    assert reports.markdown(t, ["session"], "n", "%s %s %s").first().markdown == "Ann 00:00 a & b c\n\nBo 100:00 "
    vtt = reports.web_vtt(t.filter("n < 2"), ["session"], "n").first().vtt
    assert vtt == "WEBVTT\n\n00:00:00.000 --> 00:00:01.000\n<v Ann>a &amp; b\n\n00:00:01.000 --> 00:00:01.001\n<v Ann>c\n"
    reports.write_transcripts(t, "session", "n", str(tmp_path))
    said = json.loads(spark.read.parquet(f"{tmp_path}/json").first().report)
    assert said["version"] == 1 and [r["text"] for r in said["rows"]] == ["a & b", "c", None]
    assert spark.read.parquet(f"{tmp_path}/markdown").count() == spark.read.parquet(f"{tmp_path}/vtt").count() == 1


def test_audio_headers_against_what_the_file_holds(spark, tmp_path):
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16)
    wav = lambda declared, held: b"RIFF\0\0\0\0WAVE" + fmt + b"data" + struct.pack("<I", declared) + b"\0" * held
    cases = {"complete": wav(8, 8), "short": wav(9, 4), "beyond": wav(2, 7), "header_only": wav(0, 0), "no_declared_length": wav(0xFFFFFFFF, 6), "not_a_wav": b"x", "unknown": b"RIFF\0\0\0\0WAVE" + fmt}
    for name, content in cases.items():
        (tmp_path / f"{name}.wav").write_bytes(content)
    got = {r.path.rsplit("/", 1)[1][:-4]: (r.evidence, r.bytes) for r in reports.wav_evidence(spark, str(tmp_path)).collect()}
    assert {k: e for k, (e, _) in got.items()} == {k: k for k in cases}
    assert (got["short"][1], got["beyond"][1], got["no_declared_length"][1], got["complete"][1]) == (5, 5, 6, None)


def test_spans_and_loud_windows_equal_a_walk(spark):
    """Overlapping and nested regions, spans of more pieces than one look ahead, ramps and plateaus, null keys."""
    import random

    rng = random.Random(6)
    regions = [(k, s, s + rng.choice([0, 3, 20, 150, 700]), 4000) for k in ("a", "b", None) for s in sorted(rng.randrange(3500) for _ in range(60))]
    regions += [("c", s, s + 2, 4000) for s in range(0, 400, 5)]
    want = []
    for key in ("a", "b", None, "c"):
        spans, held = [], []
        for _, s, e, size in sorted(r for r in regions if r[0] == key):
            for x in range(s, e, 480):
                y = min(x + 480, e)
                low, high = max(x - 10, 0), min(y + 10, size)
                if spans and low < spans[-1][1] + 30 and max(spans[-1][1], high) - spans[-1][0] <= 500:
                    spans[-1][1] = max(spans[-1][1], high)
                else:
                    spans.append([low, high])
                held.append((len(spans) - 1, x, y, x == s, y == e))
        want += [(key, n, *spans[n], *rest) for n, *rest in held]
    got = planning.span_plan(spark.createDataFrame(regions, "k string, start long, end long, size long"), ["k"], 10, 30, 500)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)

    loud = [(k, s, float(e)) for k in ("x", None) for s, e in enumerate(rng.choice([0, 1, 5, 5, 9, i % 50]) for i in range(300))] + [("ramp", s, float(s)) for s in range(90)]
    want = []
    for key in ("x", None, "ramp"):
        taken = []
        for s, _ in sorted(((s, e) for k, s, e in loud if k == key and e > 0), key=lambda c: (-c[1], c[0])):
            if len(taken) < 5 and all(abs(s - t) >= 7 for t in taken):
                taken.append(s)
        want += [(key, s) for s in taken]
    got = planning.loud_windows(spark.createDataFrame(loud, "k string, start long, energy double"), ["k"], 7, 5)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
