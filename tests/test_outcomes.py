"""What answers would store, and the documents that tell of it, against plain walks and written-out cases."""

import json
from collections import Counter

import pytest
from oracle import TABLES

from tideline.operators import outcomes
from tideline.plans import previews
from tideline.plans.catalog import Tables
from tideline.sources import reports

A, B, C = [1.0, 0.0], [0.0, 1.0], [0.6, 0.8]
REFS = "name string, embedding array<double>, clip_s double"
ASKS = "session int, id int, name string, embedding array<double>, speech_s double"


def told(spark, asks, refs, most=2, **how):
    got = outcomes.outcomes(spark.createDataFrame(asks, ASKS), spark.createDataFrame(refs, REFS), ["session"], most, **how)
    return {r["id"]: r for r in got.collect()}


def test_each_outcome(spark):
    refs = [("one", A, 4.0), ("full", A, 6.0), ("full", B, 9.0), ("blur", A, None), ("blur", B, None), (None, C, 1.0)]
    asks = [(1, 1, " new\t", C, 8.0), (1, 2, "one", C, 8.0), (1, 3, "one", A, 8.0), (1, 4, "full", C, 8.0), (1, 5, "full", C, 6.0), (1, 6, "blur", C, 99.0), (1, 7, "one", B, 4.9), (1, 8, "  ", A, 9.0), (1, 9, None, A, 9.0), (1, 10, "one", None, 7.0), (1, 11, "one", B, None)]
    got = told(spark, asks + asks[:2], refs)
    assert [(r["stored"], r["held"], r["evicted_s"], r["shortest_s"], r["session_only"]) for _, r in sorted(got.items())] == [
        ("enrolled", None, None, None, False), ("added", 2, None, None, False), ("already_held", None, None, None, False), ("replaced", 2, 6.0, None, False), ("at_capacity", 2, None, 6.0, True),
        ("at_capacity", 2, None, None, True), (None, None, None, None, True), (None, None, None, None, None), (None, None, None, None, None), ("added", 2, None, None, False), (None, None, None, None, True),
    ]
    assert got[1]["name"] == "new" and got[3]["displaced"] == [("blur", 1), ("full", 1)] and got[3]["stale"] == []
    assert got[7]["displaced"] == [] and got[7]["stale"] == ["blur", "full"] and got[8]["displaced"] is None and got[10]["displaced"] == []
    always = told(spark, asks, refs, always=True)
    assert always[7]["stored"] == "added" and always[7]["displaced"] == [("blur", 1), ("full", 1)] and always[7]["stale"] == []


def test_without_references_or_answers(spark):
    assert told(spark, [(1, 1, "x", A, 5.0)], [])[1]["stored"] == "enrolled"
    assert told(spark, [], [("x", A, 1.0)]) == {}


def documents(spark, rows, refs):
    asks = spark.createDataFrame([r[:5] for r in rows], ASKS)
    facts = spark.createDataFrame([(r[0], r[1], *r[5:]) for r in rows], "session int, id int, number string, verdict string, other_number string, losing string")
    got = outcomes.outcomes(asks, spark.createDataFrame(refs, REFS), ["session"], 2).join(facts, ["session", "id"])
    return {r["id"]: (json.loads(r["report"]), r["lines"].split("\n")) for r in reports.dry_runs(got, ["session"]).collect()}


def test_dry_run_documents(spark):
    refs = [("full", A, 65.0), ("full", B, 190.0), ("o'Neil \"x\"", C, 3.0)]
    rows = [
        (7, 1, "full", C, 80.0, "Unknown 1", "applied", None, None), (7, 2, "full", [9.0], 5.0, "Unknown 2", "taken", "Unknown 3", "Zoë"), (7, 3, "new", C, 1.0, "Unknown 3", "vetoed", "Unknown 1", None),
        (7, 4, "new", [9.0], 1.0, "Unknown 4", "vetoed", None, None), (7, 5, " ", A, 9.0, "Unknown 5", "applied", None, None),
    ]
    got = documents(spark, rows, refs)
    head = {"schema": reports.DRY_RUN_SCHEMA, "voice": {"session": "7", "number": "Unknown 1"}, "name": "full"}
    lost = [{"name": "o'Neil \"x\"", "remaining": 0}]
    assert got[1] == (head | {"consequence": {"refused": None, "stored": {"Replaced": {"held": 2, "evicted_seconds": 65.0}}, "session_only": False, "displaced": lost, "stale": []}}, [
        'Unknown 1 in 7, answering "full":', "  stores this recording in place of their shortest, 1m 05s, 2 in all", "  takes a recording off o'Neil \"x\", leaving them 0",
    ])
    assert got[2][0]["consequence"]["refused"] == {"Taken": {"voice": "Unknown 3", "losing": "Zoë"}} and got[2][0]["consequence"]["stored"] == {"AtCapacity": {"held": 2, "shortest": 65.0}}
    assert got[2][1][1:] == ["  unavailable: Unknown 3 would stop reading Zoë"]
    assert got[3][0]["consequence"]["refused"] == {"Vetoed": {"holder": "Unknown 1"}} and got[3][0]["consequence"]["stale"] == ["o'Neil \"x\""]
    assert got[4][0]["consequence"]["refused"] == {"Vetoed": {"holder": None}} and got[4][1][1:] == ["  unavailable: the name would not end up on this voice"]
    assert got[5][0]["consequence"] is None and got[5][0]["name"] == "" and got[5][1][1:] == ["  a name of nothing but spaces writes nothing"]


def test_voice_lists(spark):
    v = spark.createDataFrame([("s1", 1, 1, "Unknown 1", "Unknown 1", 37.4), ("s1", 2, 2, "Unknown 2", "Unknown 2", 12.0), ("s2", 1, 1, "Unknown 1", "Milo", 205.0), ("s2", 3, 2, "Unknown 2", "Ivan?", 5.0)], "session string, id int, place int, number string, label string, speech_s double")
    c = spark.createDataFrame([("s1", 1, "Bo", 0.1, 1), ("s1", 1, "Ryan", 0.62, 3), ("s1", 1, "Ann", 0.1, 2), ("s2", 1, "Milo", 0.91, 1), ("s3", 1, "Milo", 0.91, 1)], "session string, id int, name string, similarity double, n_references int")
    m = spark.createDataFrame([("s2", "Design Review")], "session string, meeting string")
    got = {r["session"]: r for r in reports.voice_lists(v, c, m).collect()}
    want = [{"number": "Unknown 1", "label": "Unknown 1", "speech_seconds": 37.4, "candidates": [{"name": n, "similarity": s, "references": k} for n, s, k in (("Ryan", 0.62, 3), ("Ann", 0.1, 2), ("Bo", 0.1, 1))]}]
    want.append({"number": "Unknown 2", "label": "Unknown 2", "speech_seconds": 12.0, "candidates": []})
    assert set(got) == {"s1", "s2"} and json.loads(got["s1"]["report"]) == {"schema": reports.LIST_SCHEMA, "sessions": [{"id": "s1", "meeting": None, "voices": want}]}
    assert json.loads(got["s2"]["report"])["sessions"][0]["meeting"] == "Design Review"
    assert got["s2"]["lines"].split("\n") == ["s2  is Unknown 1 Milo?  3m 25s of speech", "    Milo                   0.91   1 ref", "", "s2  is Unknown 2 Ivan?  5s of speech"]
    assert reports.voice_lists(v.limit(0), c, m).count() == 0


@pytest.fixture(scope="module")
def walk(spark):
    """The answers of the query, judged by a plain walk over the session, and stored by a plain list of references."""
    from test_walks import judged, sessions_of

    t = Tables(spark, TABLES)
    refs = [(r["name"], tuple(r["embedding"]), r["clip_s"]) for r in previews.held(t).collect()]
    vectors = {r["id"]: (tuple(r["embedding"]), r["speech_s"]) for r in t.clusters().collect()}
    want = []
    for s, (session, _, _, hand) in sessions_of(spark).items():
        before = session.labels(hand, {})
        numbers = {i: f"Unknown {n}" for n, i in enumerate(sorted(session.clusters, key=lambda i: (session.clusters[i][0], i)), 1)}
        for i in (i for i in session.clusters if i % 17 == 0):
            name, (vector, speech) = f"spk{i % 3}", vectors[i]
            verdict, other = judged(before, session.labels(session.by_hand(hand | {i: name}, {}, i), {}), i, name)
            refused = {"vetoed": {"Vetoed": {"holder": numbers.get(other)}}, "taken": {"Taken": {"voice": numbers.get(other), "losing": before.get(other, ("",))[0]}}, "applied": None}[verdict]
            left = [r for r in refs if r[0] == name or r[1] != vector]
            lost, mine = sorted({r[0] for r in refs if r not in left}), [r for r in refs if r[0] == name]
            least, n = min(r[2] for r in mine), len(mine)
            stored = "AlreadyHeld" if vector in {r[1] for r in mine} else {"Added": {"held": n + 1}} if n < previews.MOST_HELD else {"Replaced": {"held": n, "evicted_seconds": least}} if speech > least else {"AtCapacity": {"held": n, "shortest": least}}
            stored = stored if speech >= 5 else None
            gone = [{"name": x, "remaining": sum(r[0] == x for r in left)} for x in lost]
            only = stored is None or "AtCapacity" in stored
            consequence = {"refused": refused, "stored": stored, "session_only": only, "displaced": gone if stored else [], "stale": [] if stored else lost}
            want.append({"schema": reports.DRY_RUN_SCHEMA, "voice": {"session": str(s), "number": numbers[i]}, "name": name, "consequence": consequence})
    return want


def test_answer_documents(spark, walk):
    got = previews.answer_documents(spark, TABLES).collect()
    text = lambda d: json.dumps(d, sort_keys=True)
    assert Counter(text(json.loads(r["report"])) for r in got) == Counter(map(text, walk))
    assert len({text(d["consequence"]["refused"])[:8] for d in walk}) > 1 and any(d["consequence"]["displaced"] for d in walk) and any(d["consequence"]["stale"] for d in walk)
