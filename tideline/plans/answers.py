"""Queries over answers, labels given by hand, references left out, and what is heard at an instant, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import assign, intervals, policies, voices
from tideline.operators import vectors as vec
from tideline.plans.catalog import _BOTH, _CL, _REF, _TRIALS, CUT, LOOSE, Tables, _awarded, _labels, _near, _ranked, query  # noqa: F401
from tideline.plans.sessions import _TURNS, _turns

#: Rows given by hand: every third cluster takes a name in turn, and every ninth has a second row with another name.
_HAND = f"(SELECT session, id * 10 AS ord, id, 'spk' || id % 2 AS name FROM {_CL} WHERE id % 3 = 0 UNION ALL SELECT session, id * 10 + 1, id, 'late' FROM {_CL} WHERE id % 9 = 0)"
_FORCED = f"(SELECT session, id, 'spk' || id % 2 AS name FROM {_CL} WHERE id % 20 = 0)"
#: Rows count where one cluster of the session has their vector.
_ONE = f"(SELECT h.* FROM {_HAND} h JOIN {_CL} c USING (session, id) WHERE (SELECT count(*) FROM {_CL} o WHERE o.session = c.session AND o.embedding = c.embedding) = 1)"


def _given(t: Tables) -> DataFrame:
    c = t.clusters()
    first = c.filter("id % 3 = 0").select("session", (F.col("id") * 10).alias("ord"), F.concat(F.lit("spk"), F.col("id") % 2).alias("name"), "embedding")
    return first.unionByName(c.filter("id % 9 = 0").select("session", (F.col("id") * 10 + 1).alias("ord"), F.lit("late").alias("name"), "embedding"))


def _forced(t: Tables) -> DataFrame:
    return t.clusters().filter("id % 20 = 0").select("session", "id", F.concat(F.lit("spk"), F.col("id") % 2).alias("name"))


def _hand(t: Tables) -> DataFrame:
    resolved = vec.resolved_rows(t.clusters(), _given(t), ["session"], "ord")
    return assign.hand_awards(resolved, _forced(t), t.conflicts(), ["session"], "ord")


_AWARDED = f"(SELECT session, id, name FROM {_FORCED} UNION ALL SELECT session, id, name FROM (SELECT session, id, arg_min(name, ord) AS name FROM {_ONE} GROUP BY ALL) r WHERE NOT EXISTS (SELECT 1 FROM {_FORCED} f WHERE f.id = r.id) AND NOT EXISTS (SELECT 1 FROM {_FORCED} f JOIN {_BOTH} e ON e.a = f.id WHERE e.b = r.id AND f.name = r.name))"


@query(f"SELECT session, id, name FROM {_AWARDED}")
def hand_awards(spark, sf_dir):
    return _hand(Tables(spark, sf_dir))


@query(f"SELECT DISTINCT session, id, name FROM {_ONE}")
def denied_names(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return vec.denials(t.clusters(), _given(t), ["session"], "ord")


_LABELLED = f"(SELECT a.session, a.id, b.id AS other, round(1 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance, CASE WHEN e.a IS NOT NULL THEN 'overlapped' WHEN m.name = n.name THEN 'same' WHEN m.name IS NOT NULL AND n.name IS NOT NULL THEN 'different' ELSE 'unlabelled' END AS label FROM {_CL} a JOIN {_CL} b ON a.session = b.session AND a.id < b.id AND a.speech_s < 5 AND b.speech_s < 5 LEFT JOIN {_BOTH} e ON e.a = a.id AND e.b = b.id LEFT JOIN {_AWARDED} m ON m.id = a.id LEFT JOIN {_AWARDED} n ON n.id = b.id)"


def _labelled(spark, sf_dir) -> DataFrame:
    t = Tables(spark, sf_dir)
    return vec.labelled_pairs(t.clusters(), t.conflicts(), _hand(t), F.col("speech_s") < 5, ["session"]).withColumn("distance", F.round("distance", 6))


@query(f"SELECT * FROM {_LABELLED}")
def labelled_fragment_pairs(spark, sf_dir):
    return _labelled(spark, sf_dir)


@query(f"SELECT session, id, other, distance, label = 'same' AS same FROM {_LABELLED} WHERE label <> 'unlabelled'")
def fragment_trials(spark, sf_dir):
    return vec.trials_of(_labelled(spark, sf_dir))


_SIMS = f"(SELECT c.session, c.id, r.name, list_inner_product(c.embedding::DOUBLE[], r.rv::DOUBLE[]) AS sim FROM {_CL} c, {_REF} r)"


@query(f"SELECT session, grp, name, round(sim, 6) AS similarity, row_number() OVER (PARTITION BY session, grp ORDER BY sim DESC, name) AS rank FROM (SELECT session, id % 5 AS grp, name, max(sim) AS sim FROM {_SIMS} GROUP BY ALL)")
def merged_rankings(spark, sf_dir):
    r = _ranked(Tables(spark, sf_dir)).withColumn("grp", F.col("id") % 5)
    return vec.merged_rankings(r, ["session", "grp"]).withColumn("similarity", F.round("similarity", 6))


@query(f"WITH m AS (SELECT session, id % 30 AS grp, id, first_s, 'v' || id AS label, speech_s FROM {_CL}), g AS (SELECT session, grp, string_agg(label, ',' ORDER BY first_s, label) AS labels, sum(speech_s) AS speech_s FROM m GROUP BY ALL HAVING count(*) > 1), b AS (SELECT m.session, m.grp, s.name, max(sim) AS sim FROM {_SIMS} s JOIN m USING (session, id) GROUP BY ALL) SELECT g.session, g.grp, labels, speech_s::DOUBLE AS speech_s, name AS best, round(sim, 6) AS similarity FROM g JOIN (SELECT *, row_number() OVER (PARTITION BY session, grp ORDER BY sim DESC, name) AS n FROM b) b ON b.session = g.session AND b.grp = g.grp AND n = 1")
def fragment_bundles(spark, sf_dir):
    t = Tables(spark, sf_dir)
    m = t.clusters().select("session", (F.col("id") % 30).alias("grp"), "id", F.col("first_s").alias("place"), F.concat(F.lit("v"), "id").alias("label"), F.col("speech_s").cast("double").alias("speech_s"))
    return vec.bundles(m, _ranked(t), ["session"], "grp").withColumn("labels", F.array_join("labels", ",")).withColumn("similarity", F.round("similarity", 6))


_ITEMS = "(SELECT label AS speaker, vec_id AS session, vec_id // 40 AS grp, embedding::DOUBLE[] AS e FROM embeddings)"


@query(f"WITH i AS {_ITEMS}, n AS (SELECT grp, speaker FROM i GROUP BY ALL HAVING count(*) >= 3), p AS (SELECT i.* FROM i JOIN n USING (grp, speaker)), f AS (SELECT p.session, o.speaker AS who, arg_min(1 - list_inner_product(p.e, o.e), o.session) AS d FROM p JOIN i o ON o.grp = p.grp AND o.speaker <> p.speaker AND o.session <> p.session GROUP BY ALL), x AS (SELECT session, min(d) AS imp FROM f GROUP BY 1), q AS (SELECT p.grp, p.session, list_inner_product(p.e, a.e) AS s, list_inner_product(p.e, b.e) AS t, sqrt(list_inner_product(a.e, a.e) + list_inner_product(b.e, b.e) + 2 * list_inner_product(a.e, b.e)) AS len FROM p JOIN i a ON a.grp = p.grp AND a.speaker = p.speaker AND a.session <> p.session JOIN i b ON b.grp = p.grp AND b.speaker = p.speaker AND b.session <> p.session AND b.session <> a.session), u AS (SELECT grp, session, unnest([{{'policy': 'replace', 'mine': 1 - t}}, {{'policy': 'average', 'mine': 1 - (s + t) / len}}, {{'policy': 'set', 'mine': 1 - greatest(s, t)}}]) AS y FROM q), v AS (SELECT grp, y.policy AS policy, y.mine AS mine, coalesce(imp, 'infinity'::DOUBLE) AS far FROM u LEFT JOIN x USING (session)) SELECT grp, policy, count(*) AS combinations, count(*) FILTER (least(mine, far) < 0.8 AND mine <= far) AS correct, count(*) FILTER (least(mine, far) < 0.8 AND mine > far) AS wrong, count(*) FILTER (least(mine, far) >= 0.8) AS refused, count(*) FILTER (far < 0.8) AS open_accepted, 0 AS impostors_refused FROM v GROUP BY ALL")
def policy_sweep(spark, sf_dir):
    """Each vector is a session of its own; speakers meet within groups of 40 ids."""
    i = Tables(spark, sf_dir).embeddings.select(F.col("label").alias("speaker"), F.col("vec_id").alias("session"), F.floor(F.col("vec_id") / 40).alias("grp"), F.col("embedding").cast("array<double>").alias("embedding"))
    return policies.policy_sweep(i, 0.8, ["grp"])


# --- answers and scenarios


@query()
def answer_previews(spark, sf_dir):
    """What naming every 17th cluster after its left neighbour's label would do to its session; each answer is tried for itself."""
    t = Tables(spark, sf_dir)
    asked = t.clusters().filter("id % 17 = 0").select("session", "id", F.concat(F.lit("spk"), F.col("id") % 3).alias("name"))
    return assign.answer_verdicts(asked, t.clusters(), _near(t), _hand(t), t.conflicts(), ["session"], CUT, LOOSE)


@query()
def denial_previews(spark, sf_dir):
    """What the tentative names read once they are refused."""
    t = Tables(spark, sf_dir)
    hand = _hand(t)
    none = hand.limit(0)
    return assign.label_changes(t.clusters(), _near(t), hand, none, none, t.conflicts(), ["session"], CUT, LOOSE, refused=True)


@query()
def removal_scan(spark, sf_dir):
    """For each reference, the labels that would change without it, and whether they are its own name's (depends)."""
    t = Tables(spark, sf_dir)
    two = assign.best_two(_ranked(t, max(CUT, LOOSE)), ["session"])
    moved = assign.removal_changes(t.clusters(), two, t.conflicts(), ["session"], CUT, LOOSE)
    owner = t.references().select(F.col("vec_id").alias("reference"), "name")
    return moved.join(owner, "reference").select("reference", "session", "id", "label", "new_label", (F.col("label") == F.col("name")).alias("depends"))


# --- instants


def _instants(t: Tables) -> DataFrame:
    every = F.sequence(F.lit(0).cast("long"), F.lit(60).cast("long"), F.lit(4).cast("long"))
    return t.conversations.select("conv_id").distinct().withColumn("at_s", F.explode(every))


_AT = "(SELECT conv_id, unnest(range(0, 61, 4)) AS at_s FROM (SELECT DISTINCT conv_id FROM conversations))"


@query(f"SELECT conv_id, at_s, arg_min(turn, (g, turn)) AS seq, round(min(g), 6) AS gap_s FROM (SELECT conv_id, at_s, turn, CASE WHEN at_s < start_s THEN start_s - at_s ELSE greatest(at_s - end_s, 0) END AS g FROM {_AT} JOIN {_TURNS} USING (conv_id)) GROUP BY ALL")
def nearest_turns(spark, sf_dir):
    t = Tables(spark, sf_dir)
    turns = _turns(t).select("conv_id", F.col("turn").alias("seq"), "start_s", "end_s")
    return intervals.nearest_turn(turns, _instants(t), "conv_id").withColumn("gap_s", F.round("gap_s", 6))


@query(f"WITH t AS (SELECT conv_id, turn AS seq, turn * 3.0::DOUBLE AS s, turn * 3.0::DOUBLE + 5 AS e, CASE WHEN turn % 5 <> 4 THEN turn % 3 END AS cluster FROM conversations), c AS (SELECT a.*, t.seq, t.cluster, s, CASE WHEN floor(s) = at_s THEN 1 WHEN s <= at_s AND at_s < e THEN 2 END AS tier FROM {_AT} a JOIN t USING (conv_id)), b AS (SELECT conv_id, at_s, arg_min({{'c': cluster}}, (tier, s, seq)).c AS cluster, count(DISTINCT cluster) AS voices, count(*) AS n FROM c WHERE tier IS NOT NULL GROUP BY ALL), m AS (SELECT conv_id, max(e) AS last FROM t GROUP BY 1), r AS (SELECT a.conv_id, a.at_s, CASE WHEN b.n IS NULL AND a.at_s >= last THEN 'past_end' WHEN b.n IS NULL THEN 'silence' WHEN b.cluster IS NULL THEN 'no_cluster' WHEN voices > 1 THEN 'several' WHEN b.cluster = 2 THEN 'unknown_voice' ELSE 'ok' END AS status, b.cluster FROM {_AT} a LEFT JOIN b USING (conv_id, at_s) JOIN m ON m.conv_id = a.conv_id) SELECT conv_id, at_s, status, CASE WHEN status = 'ok' THEN cluster END AS cluster FROM r")
def voices_at_time(spark, sf_dir):
    """Turns overlap by two seconds, every fifth has no voice, and voice 2 is missing from the table of voices."""
    t = Tables(spark, sf_dir)
    s = (F.col("turn") * 3).cast("double")
    turns = t.conversations.select("conv_id", F.col("turn").alias("seq"), s.alias("start_s"), (s + 5).alias("end_s"), F.when(F.col("turn") % 5 != 4, F.col("turn") % 3).alias("cluster"))
    known = turns.filter("cluster < 2").select("conv_id", "cluster").distinct()
    return intervals.voice_at_time(intervals.point_lookup(turns, _instants(t), "conv_id"), known, "conv_id")


@query(f"SELECT conv_id, turn, left(trim(text), 100) AS snippet, greatest(start_s - 10, 0)::DOUBLE AS at_s, (greatest(end_s - 10, greatest(start_s - 10, 0)) - greatest(start_s - 10, 0))::DOUBLE AS duration_s FROM {_TURNS} WHERE speaker <> 'user' AND turn % 4 <> 0 AND trim(text) <> ''")
def turn_snippets(spark, sf_dir):
    t = _turns(Tables(spark, sf_dir)).withColumn("track", F.when(F.col("speaker") == "user", "mic").otherwise("speaker")).withColumn("cluster", F.when(F.col("turn") % 4 != 0, F.col("turn") % 4))
    return intervals.snippets(t, ["conv_id"], F.lit(10.0)).select("conv_id", "turn", "snippet", "at_s", "duration_s")


@query(f"WITH v AS (SELECT session, id, 'Unknown ' || row_number() OVER (PARTITION BY session ORDER BY first_s, id) AS label FROM {_CL}) SELECT v.session, v.id, v.label, a.name AS new_label FROM v JOIN {_AWARDED} a ON a.id = v.id")
def renamed_voices(spark, sf_dir):
    """Voices that read another label once names given by hand count."""
    t = Tables(spark, sf_dir)
    c = t.clusters()
    none = _hand(t).limit(0)
    before = voices.unknown_numbers(c, ["session"])
    after = assign.labels(c, none, _hand(t), none, none, none, t.conflicts(), ["session"])
    return assign.changed_labels(before, after, ["session"])
