"""Labels derived in one group a session: as the joins derive them, from one shuffle, and from exactly compared vectors."""

import numpy as np
import pytest
from oracle import TABLES
from pyspark.sql import functions as F

from tideline.functions.vectors import comparable_cosine
from tideline.operators import assign
from tideline.operators import vectors as vec
from tideline.plans import catalog

CUT, LOOSE = 0.6, 0.8


@pytest.fixture(scope="module")
def facts(spark):
    """Sessions whose similarities tie often: clusters, pairs with references, conflicts, and names given by hand."""
    rng = np.random.default_rng(5)
    clusters = [(s, s * 10 + i, float(rng.integers(0, 4)) if i else None, float(rng.integers(1, 9))) for s in range(6) for i in range(8)]
    pairs = [(s, i, f"n{r % 3}", r, int(rng.integers(0, 9)) / 10 - i % 2 * 0.4) for s, i, *_ in clusters for r in range(9)]
    edges = sorted({(s, s * 10 + int(a), s * 10 + int(b)) for s in range(6) for a, b in rng.integers(0, 8, (6, 2)) if a != b})
    made = lambda rows, schema: spark.createDataFrame(rows, schema).localCheckpoint()
    c = made(clusters, "session long, id long, first_s double, speech_s double")
    named = "session long, id long, name string"
    hand = made([(s, s * 10 + i, f"n{i % 3}") for s in range(6) for i in (1, 4)], named)
    forced = made([(s, s * 10 + 2, "n1") for s in range(0, 6, 2)], named)
    denied = made([(s, s * 10 + i, f"n{i % 3}") for s in range(6) for i in range(8)], named)
    return c, made(pairs, "session long, id long, name string, reference long, similarity double"), made(edges, "session long, a long, b long"), hand, forced, denied


def joined(clusters, ranked, hand, denied, forced, conflicts, keys):
    """By the operators that derive each kind of label on its own."""
    nearest = ranked.groupBy(*keys, "id").agg(F.min(F.struct((-F.col("similarity")).alias("d"), "name")).alias("b")).select(*keys, "id", "b.name", (-F.col("b.d")).alias("similarity"))
    awarded = assign.award_names(nearest.filter(1 - F.col("similarity") < CUT), conflicts, keys)
    short = ranked.join(clusters.filter("speech_s < 5").select(*keys, "id"), [*keys, "id"])
    return assign.labels(clusters, forced, hand, awarded, assign.tentative_names(short, awarded, conflicts, keys, LOOSE), denied, conflicts, keys)


def test_labels_of_one_walk_are_those_of_the_joins_from_one_shuffle(spark, facts):
    clusters, pairs, edges, hand, forced, denied = facts
    ranked = pairs.groupBy("session", "id", "name").agg(F.max("similarity").alias("similarity")).localCheckpoint()
    got = assign.derived_labels(clusters, ranked, hand, denied, forced, edges, ["session"], CUT, LOOSE)
    want = joined(clusters, ranked, hand, denied, forced, edges, ["session"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {r.kind for r in got.collect()} == {"forced", "assigned", "identified", "tentative", "unknown"}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1


def test_removals_are_tried_without_a_copy_of_the_rankings_for_each(spark, facts):
    clusters, pairs, edges, hand, *_ = facts
    none = hand.limit(0)
    ranked = pairs.groupBy("session", "id", "name").agg(F.max("similarity").alias("similarity"))
    less = assign.without_each(pairs, ["session"], LOOSE).localCheckpoint()
    each = lambda df: less.select("scenario", "session").distinct().join(df, "session")
    keys = ["scenario", "session"]
    after = joined(each(clusters), less, each(none), each(none), each(none), each(edges), keys)
    want = assign.changed_labels(each(joined(clusters, ranked, none, none, none, edges, ["session"])), after, keys)
    got = assign.removal_changes(clusters, assign.best_two(pairs, ["session"]), edges, ["session"], CUT, LOOSE)
    assert got.count() > 20 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_answers_are_tried_in_one_walk_as_the_joins_try_each(spark, facts):
    clusters, pairs, edges, hand, _, denied = facts
    ranked = pairs.groupBy("session", "id", "name").agg(F.max("similarity").alias("similarity")).localCheckpoint()
    asked = denied.unionByName(denied.select("session", (F.col("session") * 10 + 9).alias("id"), "name").distinct()).withColumn("scenario", F.concat_ws("/", "id", "name")).localCheckpoint()
    keys, none = ["scenario", "session"], asked.limit(0).select("scenario", "session", "id", "name")
    each = lambda df: asked.select("scenario", "session").join(df, "session")
    derive = lambda given: joined(each(clusters), each(ranked), given, none, none, each(edges), keys)
    standing = each(hand).localCheckpoint()
    rows = standing.join(asked.select(*keys, "id"), [*keys, "id"], "left_anti").withColumn("ord", F.lit(0)).unionByName(asked.withColumn("ord", F.lit(1)))
    given = assign.hand_awards(rows, none, each(edges), keys, "ord", asked)
    want = assign.judged_answers(asked, derive(standing).localCheckpoint(), derive(given).localCheckpoint(), keys).drop("scenario").collect()
    told = assign.answer_verdicts(asked.drop("scenario"), clusters, ranked, hand, edges, ["session"], CUT, LOOSE)
    assert sorted(map(str, told.collect())) == sorted(map(str, want)) and {r.verdict for r in want} == {"vetoed", "taken", "applied"}
    odd = spark.createDataFrame([(0, None, "n1"), (0, 1, None), (None, 1, "n1"), (77, 770, "n1")], "session long, id long, name string")
    assert [tuple(r) for r in assign.answer_verdicts(odd, clusters, ranked, hand, edges.unionByName(edges.withColumn("b", F.lit(None).cast("long"))), ["session"], CUT, LOOSE).collect()] == [(77, 770, "n1", "vetoed", None)]
    assert assign.answer_verdicts(odd.limit(0), clusters, ranked, hand, edges, ["session"], CUT, LOOSE).count() == 0


@pytest.mark.parametrize("without, refused", [("n1", False), (None, True), ("n1", True)])
def test_changed_labels_come_from_one_walk_as_from_two_and_a_join(spark, facts, without, refused):
    clusters, pairs, edges, hand, forced, denied = facts
    ranked = pairs.groupBy("session", "id", "name").agg(F.max("similarity").alias("similarity")).localCheckpoint()
    some = denied.filter("id % 2 = 0")
    before = joined(clusters, ranked, hand, some, forced, edges, ["session"]).localCheckpoint()
    tentative = before.filter("kind = 'tentative'").select("session", "id", F.col("label").alias("name"))
    after = joined(clusters, ranked.filter(F.col("name") != (without or "")), hand, some.unionByName(tentative) if refused else some, forced, edges, ["session"])
    got = assign.label_changes(clusters, ranked, hand, some, forced, edges, ["session"], CUT, LOOSE, without=without, refused=refused)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, assign.changed_labels(before, after, ["session"]).collect())) and got.count()
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_changed_labels_of_a_cluster_that_comes_twice_are_those_of_the_join(spark, facts):
    clusters, pairs, edges, hand, forced, denied = facts
    ranked = pairs.groupBy("session", "id", "name").agg(F.max("similarity").alias("similarity")).localCheckpoint()
    twice = clusters.unionByName(clusters.filter("id % 3 = 0")).unionByName(clusters.limit(2).withColumn("session", F.lit(None).cast("long"))).localCheckpoint()
    derive = lambda near: assign.derived_labels(twice, near, hand, denied, forced, edges, ["session"], CUT, LOOSE)
    want = assign.changed_labels(derive(ranked), derive(ranked.filter("name <> 'n1'")), ["session"]).collect()
    got = assign.label_changes(twice, ranked, hand, denied, forced, edges, ["session"], CUT, LOOSE, without="n1").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({(r.id, r.label) for r in want}) < len(want)


@pytest.mark.parametrize("name", ["answer_previews", "denial_previews", "labels_without_a_name"])
def test_a_query_of_labels_walks_its_sessions_once(spark, monkeypatch, name):
    walks, facts_of = [], assign._facts
    monkeypatch.setattr(assign, "_facts", lambda *a, **k: walks.append(1) or facts_of(*a, **k))
    plan = catalog.queries()[name](spark, TABLES)._jdf.queryExecution().optimizedPlan().toString()
    assert len(walks) == 1 and plan.count("FlatMapGroupsInArrow") == 1


@pytest.mark.parametrize("most", [vec.MOST_BROADCAST, 0])
def test_vectors_of_one_file_are_compared_by_all_cores_and_to_the_last_bit(spark, most):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=64 if i % 3 else 7)]) for i in range(60)] + [(60, None), (61, []), (62, [None] + [1.0] * 6)]
    table = spark.createDataFrame(rows, "id long, embedding array<float>").coalesce(1)
    right = table.filter("id < 20 OR id > 59").select(F.col("id").alias("reference"), "embedding")
    got = vec.compared(table, right, most=max(most, 1))
    want = table.crossJoin(right.withColumnRenamed("embedding", "r")).select("id", "reference", comparable_cosine(F.col("embedding"), F.col("r")).alias("similarity")).filter("similarity IS NOT NULL")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 500
    near = vec.compared(table, right, under=0.9, most=max(most, 1))
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, want.filter(1 - F.col("similarity") < 0.9).collect()))
    if most:
        assert got.rdd.getNumPartitions() > 1
