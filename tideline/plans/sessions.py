"""Queries over plans of a timeline, voices, names, caches and reports, with their SQL. Registered with the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import vectors as V
from tideline.operators import cache, names, planning, segments, voices
from tideline.operators import vectors as vec
from tideline.plans.catalog import _CL, _EDGE, _FR, CUT, EVENTS, Tables, _frames, query
from tideline.plans.meetings import greedy
from tideline.sources import reports

_TURNS = "(SELECT conv_id, turn, role AS speaker, turn * 7.5::DOUBLE AS start_s, turn * 7.5::DOUBLE + (turn % 4) * 0.5::DOUBLE AS end_s, text FROM conversations)"


def _turns(t: Tables) -> DataFrame:
    s = F.col("turn") * F.lit(7.5).cast("double")
    return t.conversations.select("conv_id", "turn", F.col("role").alias("speaker"), s.alias("start_s"), (s + (F.col("turn") % 4) * F.lit(0.5).cast("double")).alias("end_s"), "text")


@query(f"SELECT conv_id, turn, track, start_s, row_number() OVER (PARTITION BY conv_id ORDER BY start_s, track, turn) AS position FROM (SELECT conv_id, turn, CASE WHEN speaker = 'user' THEN 'mic' ELSE 'speaker' END AS track, start_s + CASE WHEN speaker = 'user' THEN 0.0 ELSE 7.5 END::DOUBLE AS start_s FROM {_TURNS})")
def merged_tracks(spark, sf_dir):
    """The user's track started 7.5 s before the other's."""
    t = _turns(Tables(spark, sf_dir))
    mic, speaker = planning.track_offsets(F.lit(100).cast("long"), F.lit(7_500_000_100).cast("long"), F.lit(1).cast("long"), F.lit(1).cast("long"))
    both = planning.merge_tracks(t.filter("speaker = 'user'").withColumn("offset_s", mic), t.filter("speaker <> 'user'").withColumn("offset_s", speaker), ["conv_id"], "turn")
    return both.select("conv_id", "turn", "track", "start_s", "position")


@query("WITH r AS (SELECT conv_id, turn * 8 AS s, turn * 8 + 5 AS e FROM conversations), p AS (SELECT *, s + 0 AS a, coalesce(sum(e - s + 2) OVER (PARTITION BY conv_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x FROM r), q AS (SELECT conv_id, unnest(range(0, 60, 2)) AS pos FROM (SELECT DISTINCT conv_id FROM r)), b AS (SELECT q.conv_id, q.pos, p.s, p.e, p.x, row_number() OVER (PARTITION BY q.conv_id, q.pos ORDER BY CASE WHEN x + e - s > pos THEN x ELSE 1000000 - x END) AS n FROM q JOIN p USING (conv_id)) SELECT conv_id, pos, least(s + greatest(pos - x, 0), e)::DOUBLE AS original_s FROM b WHERE n = 1")
def mapped_positions(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations
    r = c.select("conv_id", (F.col("turn") * 8).cast("double").alias("start_s"), (F.col("turn") * 8 + 5).cast("double").alias("end_s"))
    at = c.select("conv_id").distinct().withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(58).cast("long"), F.lit(2).cast("long"))))
    return planning.map_back(segments.splice(r, ["conv_id"], 0.0, 2.0), at, ["conv_id"])


@query("SELECT doc_id, window_start FROM (SELECT doc_id, unnest(list_distinct(list_append(range(0, greatest(n_chars - 400, 0) + 1, 300), greatest(n_chars - 400, 0)))) AS window_start FROM documents WHERE n_chars > 0)")
def window_plan(spark, sf_dir):
    return planning.window_plan(Tables(spark, sf_dir).documents.select("doc_id", "n_chars"), "n_chars", 400, 300).select("doc_id", "window_start")


def _regions(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", (F.col("turn") * 900).alias("start"), (F.col("turn") * 900 + (F.col("turn") * 37 % 11) * 90).alias("end"), F.lit(100_000).cast("long").alias("size"))


@query(
    "WITH RECURSIVE r AS (SELECT conv_id, turn * 900 AS s, turn * 900 + (turn * 37 % 11) * 90 AS e, 100000 AS size FROM conversations), p AS (SELECT *, unnest(range(s, e, 1900)) AS a FROM r), q AS (SELECT *, least(a + 1900, e) AS b, row_number() OVER (PARTITION BY conv_id ORDER BY s, e, a) AS n FROM p), k AS (SELECT *, greatest(a - 50, 0) AS low, least(b + 50, size) AS high FROM q),"
    " w AS (SELECT conv_id, n, 0::BIGINT AS span, low AS first, high AS last FROM k WHERE n = 1 UNION ALL SELECT conv_id, n, CASE WHEN near THEN span ELSE span + 1 END, CASE WHEN near THEN first ELSE low END, CASE WHEN near THEN greatest(last, high) ELSE high END FROM (SELECT w.conv_id, k.n, w.span, w.first, w.last, k.low, k.high, k.low < w.last + 150 AND greatest(w.last, k.high) - w.first <= 2000 AS near FROM w JOIN k ON k.conv_id = w.conv_id AND k.n = w.n + 1))"
    " SELECT k.conv_id, w.span, min(first) OVER v AS \"start\", max(last) OVER v AS \"end\", a AS piece_start, b AS piece_end, a = s AS fade_in, b = e AS fade_out FROM k JOIN w USING (conv_id, n) WINDOW v AS (PARTITION BY k.conv_id, w.span)"
)
def span_plan(spark, sf_dir):
    return planning.span_plan(_regions(Tables(spark, sf_dir)), ["conv_id"], 50, 150, 2000)


@query(greedy(f"SELECT user_id, i AS start, round(p * p, 6) AS energy FROM {_FR}", 4, 3))
def loud_windows(spark, sf_dir):
    f = _frames(spark, sf_dir)
    return planning.loud_windows(f.select("user_id", F.col("i").alias("start"), F.round(F.col("p") * F.col("p"), 6).alias("energy")), ["user_id"], 4, 3)


_LAG = f"(SELECT user_id, i, 2 * i + user_id * 7 % 13 * i % 3 + CASE WHEN (i * 31 + user_id) % 17 = 0 THEN 500 ELSE 0 END AS lag FROM {_FR})"


@query(f"WITH p AS {_LAG}, m AS (SELECT a.user_id, a.i, list_sort(list((b.lag - a.lag) / (b.i - a.i)))[count(*) // 2 + 1] AS s FROM p a JOIN p b ON a.user_id = b.user_id AND a.i <> b.i GROUP BY ALL), f AS (SELECT user_id, list_sort(list(s))[count(*) // 2 + 1] AS slope FROM m GROUP BY 1), g AS (SELECT user_id, any_value(slope) AS slope, list_sort(list(lag - slope * i))[count(*) // 2 + 1] AS c FROM p JOIN f USING (user_id) GROUP BY 1), r AS (SELECT p.*, slope, c, lag - round(c + slope * i) AS r FROM p LEFT JOIN g USING (user_id)), d AS (SELECT *, abs(r - list_sort(list(r) OVER w)[count(*) OVER w // 2 + 1]) AS d, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY user_id)), e AS (SELECT *, n >= 3 AND d <= greatest(4 * list_sort(list(d) OVER w)[count(*) OVER w // 2 + 1], 2) AS k FROM d WINDOW w AS (PARTITION BY user_id)), h AS (SELECT user_id, count(*) FILTER (k) AS windows, (max(r) FILTER (k) - min(r) FILTER (k))::BIGINT AS spread, any_value(slope) AS slope, any_value(c) AS c, min(i) FILTER (k) AS a, max(i) FILTER (k) AS b FROM e GROUP BY 1), z AS (SELECT *, CASE WHEN windows < 3 THEN 'too_few_windows' WHEN spread > 3 THEN 'inconsistent_windows' ELSE 'measured' END AS result FROM h) SELECT user_id, result, CASE WHEN result = 'measured' THEN round(c + slope * (a + (b - a) / 2))::BIGINT END AS lag, windows, spread, CASE WHEN result = 'measured' THEN round(slope, 6) END AS slope FROM z")
def steady_lags(spark, sf_dir):
    f = _frames(spark, sf_dir)
    lag = 2 * F.col("i") + F.col("user_id") * 7 % 13 * F.col("i") % 3 + F.when((F.col("i") * 31 + F.col("user_id")) % 17 == 0, 500).otherwise(0)
    return planning.steady_lags(f.select("user_id", "i", lag.alias("lag")), ["user_id"], "i", "lag", 2, 3).withColumn("slope", F.round("slope", 6))


@query(f"SELECT user_id, event_id, waited FROM (SELECT user_id, event_id, s - lag(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS waited FROM {EVENTS}) WHERE waited > greatest(86400, 8 * 3600)")
def stalls(spark, sf_dir):
    e = Tables(spark, sf_dir).events_s()
    return planning.stalls(e, ["user_id"], "s", "event_id", F.greatest(F.lit(86400), 8 * F.lit(3600))).select("user_id", "event_id", "waited")


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, nullif(event_type, 'purchase') AS d, lag(nullif(event_type, 'purchase')) OVER (PARTITION BY user_id ORDER BY event_id) AS was FROM events) WHERE was IS NOT NULL AND was IS DISTINCT FROM d")
def device_changes(spark, sf_dir):
    e = Tables(spark, sf_dir).events.withColumn("device", F.nullif("event_type", F.lit("purchase")))
    return planning.device_changes(e, ["user_id"], "event_id", "device").select("user_id", "event_id")


@query(f"WITH b AS (SELECT user_id, s - lag(s) OVER w AS gap, row_number() OVER w AS n, s - min(s) OVER (PARTITION BY user_id) - 3600 * coalesce(sum(event_id % 5) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS d FROM {EVENTS} WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)) SELECT user_id, max(gap) FILTER (n = 2) AS first_gap, (list_sort(list(gap) FILTER (gap IS NOT NULL)))[count(gap) // 2 + 1] AS median_gap, min(gap) AS least_gap, max(gap) AS most_gap, max(abs(d))::DOUBLE AS most_drift, count(*) AS n FROM b GROUP BY user_id")
def timing_profile(spark, sf_dir):
    e = Tables(spark, sf_dir).events_s().withColumn("frames", F.col("event_id") % 5)
    return planning.timing_profile(e, ["user_id"], "s", "event_id", "frames", 3600.0)


@query("SELECT o AS session, CASE WHEN s IS NULL THEN 'missing' WHEN s = 'orphaned' THEN 'orphaned' WHEN s = 'transcribed' THEN 'done' ELSE 'selected' END AS status FROM (SELECT DISTINCT o_custkey * 2 AS o FROM orders) LEFT JOIN (SELECT c_custkey AS k, CASE c_nationkey % 3 WHEN 0 THEN 'orphaned' WHEN 1 THEN 'transcribed' ELSE 'valid' END AS s FROM customer) ON o = k")
def batch_selection(spark, sf_dir):
    t = Tables(spark, sf_dir)
    state = F.when(F.col("c_nationkey") % 3 == 0, "orphaned").when(F.col("c_nationkey") % 3 == 1, "transcribed").otherwise("valid")
    return planning.batch_selection(t.customer.select(F.col("c_custkey").alias("session"), state.alias("state")), t.orders.select((F.col("o_custkey") * 2).alias("session")))


@query("WITH g AS (SELECT conv_id, turn % 3 AS slot, sum(end_s - start_s) AS speech_s, min(start_s) AS first_s FROM " + _TURNS + " WHERE end_s - start_s >= 0.5 GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY speech_s DESC, slot) - 1 AS id, 'Unknown ' || row_number() OVER (PARTITION BY conv_id ORDER BY first_s, speech_s DESC, slot) AS label FROM g")
def assembled_clusters(spark, sf_dir):
    t = _turns(Tables(spark, sf_dir)).withColumn("slot", F.col("turn") % 3)
    return voices.unknown_numbers(voices.assemble(t, ["conv_id"], "slot"), ["conv_id"])


@query("WITH k AS (SELECT vec_id // 40 AS session, vec_id % 4 AS slot, (vec_id * 7 % 101)::DOUBLE AS start_s, (vec_id % 13) * 0.25::DOUBLE AS size, embedding FROM embeddings WHERE (vec_id % 13) * 0.25::DOUBLE >= 0.5 AND len(embedding) > 0), g AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY speech_s DESC, slot) - 1 AS id FROM (SELECT session, slot, sum(size) AS speech_s, min(start_s) AS first_s FROM k GROUP BY ALL)), m AS (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY session, slot)) AS length FROM (SELECT session, slot, i, avg(x::DOUBLE) AS m FROM (SELECT session, slot, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS x FROM k) GROUP BY ALL)) SELECT session, slot, id, speech_s, first_s, i, round(m / length, 6) AS x FROM g JOIN m USING (session, slot)")
def assembled_voices(spark, sf_dir):
    """Every component of the embeddings of assembled clusters; the vectors of 40 consecutive ids are turns of one session."""
    start, id_ = (F.col("vec_id") * 7 % 101).cast("double"), F.col("vec_id")
    turns = Tables(spark, sf_dir).embeddings.select(F.floor(id_ / 40).alias("session"), (id_ % 4).alias("slot"), start.alias("start_s"), (start + (id_ % 13) * F.lit(0.25).cast("double")).alias("end_s"), "embedding")
    clusters = voices.assemble(turns, ["session"], "slot", vector="embedding")
    return clusters.select("session", "slot", "id", "speech_s", "first_s", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.round("x", 6))


@query(f"WITH t AS (SELECT conv_id, turn, start_s, end_s, end_s - start_s AS d, row_number() OVER (PARTITION BY conv_id ORDER BY end_s - start_s DESC, turn) AS rep FROM {_TURNS}), s AS (SELECT *, greatest(start_s - (1.5 - d) / 2, 0) AS x FROM t WHERE rep <= 3) SELECT conv_id, turn, rep, CASE WHEN d >= 1.5 THEN start_s WHEN x + 1.5 > 40 THEN greatest(40 - 1.5, 0) ELSE x END::DOUBLE AS rep_start_s, CASE WHEN d >= 1.5 THEN end_s WHEN x + 1.5 > 40 THEN 40 ELSE x + 1.5 END::DOUBLE AS rep_end_s FROM s")
def representative_turns(spark, sf_dir):
    t = _turns(Tables(spark, sf_dir)).withColumn("size", F.lit(40.0))
    return voices.representatives(t, ["conv_id"], "turn", "size").select("conv_id", "turn", "rep", "rep_start_s", "rep_end_s")


_VOICES = f"(SELECT session, id, first_s, speech_s, id % 3 = 0 AS named, id % 5 = 1 AS tentative, id % 7 = 2 AS denied FROM {_CL})"


def _voices(t: Tables) -> DataFrame:
    flag = lambda n, r: F.col("id") % n == r
    return t.clusters().select("session", "id", "first_s", "speech_s", flag(3, 0).alias("named"), flag(5, 1).alias("tentative"), flag(7, 2).alias("denied"))


@query(f"WITH c AS (SELECT *, max(speech_s >= 5) OVER (PARTITION BY session) AS a FROM {_VOICES} WHERE NOT named AND NOT (speech_s < 5 AND (tentative OR denied))) SELECT session, id, row_number() OVER (PARTITION BY session ORDER BY first_s, id) AS place FROM c WHERE speech_s >= 5 OR NOT a")
def prompt_queue(spark, sf_dir):
    return voices.prompt_queue(_voices(Tables(spark, sf_dir)), ["session"]).select("session", "id", "place")


@query(f"WITH v AS (SELECT session, id, 'Unknown ' || row_number() OVER (PARTITION BY session ORDER BY first_s, id) AS u, 'spk' || label AS shown FROM {_CL}), w AS (SELECT session, id, u AS k FROM v UNION SELECT session, id, shown FROM v), q AS (SELECT session, unnest(['1', '7', '999', 'Unknown 3', 'spk4', 'spk77']) AS typed FROM (SELECT DISTINCT session FROM v)) SELECT q.session, typed, CASE count(DISTINCT id) WHEN 0 THEN 'none' WHEN 1 THEN 'ok' ELSE 'several' END AS status, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS id FROM q LEFT JOIN w ON q.session = w.session AND k = CASE WHEN regexp_full_match(typed, '[0-9]+') THEN 'Unknown ' || typed ELSE typed END GROUP BY q.session, typed")
def picked_voices(spark, sf_dir):
    c = Tables(spark, sf_dir).clusters()
    v = voices.unknown_numbers(c.withColumn("shown", F.concat(F.lit("spk"), "label")), ["session"]).withColumnRenamed("label", "number_label")
    asked = c.select("session").distinct().withColumn("typed", F.explode(F.array(*map(F.lit, ("1", "7", "999", "Unknown 3", "spk4", "spk77")))))
    return voices.pick_voice(asked, v, ["session"])


@query(f"WITH c AS {_CL}, e AS (SELECT session, a, b FROM {_EDGE} UNION SELECT session, b, a FROM {_EDGE}), o AS (SELECT e.session, count(DISTINCT e.a) AS n FROM e JOIN c x ON x.id = e.a JOIN c y ON y.id = e.b WHERE (y.first_s, y.id) < (x.first_s, x.id) GROUP BY 1) SELECT c.session, count(*) AS voices, coalesce(any_value(n), 0) AS overridden FROM c LEFT JOIN o USING (session) GROUP BY c.session")
def one_speaker_cost(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return voices.one_speaker_cost(t.clusters(), t.conflicts(), ["session"])


def _items(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("label").alias("name"), "vec_id", "embedding")


@query("SELECT policy, name, count(*) AS n, round(sum(list_inner_product(e, e)), 4) AS mass FROM (SELECT 'set' AS policy, label AS name, embedding::DOUBLE[] AS e FROM embeddings UNION ALL SELECT 'replace', label, arg_max(embedding, vec_id)::DOUBLE[] FROM embeddings GROUP BY label UNION ALL SELECT 'average', label, list(m / len ORDER BY i) FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY label)) AS len FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY ALL)) GROUP BY label) GROUP BY policy, name")
def policy_references(spark, sf_dir):
    p = voices.policy_references(_items(Tables(spark, sf_dir)), "name", "vec_id", "embedding")
    return p.groupBy("policy", "name").agg(F.count("*").alias("n"), F.round(F.sum(V.dot(F.col("embedding"), F.col("embedding"))), 4).alias("mass"))


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) SELECT p.vec_id AS probe, p.label AS speaker, r.label AS other, round(min(1 - list_inner_product(p.embedding::DOUBLE[], r.embedding::DOUBLE[])), 6) AS distance, p.label = r.label AS own FROM n p, n r WHERE p.n > 2 AND r.n <= 2 GROUP BY ALL")
def distance_populations(spark, sf_dir):
    return voices.distance_populations(_items(Tables(spark, sf_dir)), "name", "vec_id", "embedding").withColumn("distance", F.round("distance", 6))


@query(f"WITH n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings), d AS (SELECT p.label AS sp, r.label AS name, round(1 - list_inner_product(p.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9) AS d, row_number() OVER (PARTITION BY p.vec_id ORDER BY round(1 - list_inner_product(p.embedding::DOUBLE[], r.embedding::DOUBLE[]), 9), r.label) AS k FROM n p, n r WHERE p.n > 1 AND r.n = 1 AND r.label < 7) SELECT count(*) FILTER (sp < 7 AND d < {CUT} AND name = sp) AS named_right, count(*) FILTER (sp < 7 AND d < {CUT} AND name <> sp) AS named_wrong, count(*) FILTER (sp < 7 AND d >= {CUT}) AS refused, count(*) FILTER (sp >= 7 AND d < {CUT}) AS strangers_named, count(*) FILTER (sp >= 7 AND d >= {CUT}) AS strangers_refused FROM d WHERE k = 1")
def identification_report(spark, sf_dir):
    """Each speaker's first vector is enrolled, of speakers 7 and up none."""
    n = _items(Tables(spark, sf_dir)).withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy("vec_id")))
    refs, probes = n.filter("_n = 1 AND name < 7").select("name", F.col("embedding").alias("_e")), n.filter("_n > 1").select(F.col("name").alias("speaker"), "vec_id", F.col("embedding").alias("_p"))
    near = vec.against(probes, refs).withColumn("d", F.round(V.cosine_distance(F.col("_p"), F.col("_e")), 9)).groupBy("vec_id", "speaker").agg(F.min(F.struct("d", "name")).alias("m"))
    return voices.identification_report(near.select("speaker", F.col("m.name").alias("name"), F.col("m.d").alias("distance")), CUT, F.col("speaker") < 7)


@query("SELECT a.label AS a, b.label AS b, round(avg(1 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS average FROM embeddings a JOIN embeddings b ON a.label < b.label GROUP BY ALL")
def group_distances(spark, sf_dir):
    return voices.group_distances(_items(Tables(spark, sf_dir)), "name", "embedding").select("a", "b", F.round("average", 6).alias("average"))


@query("WITH p(profile, pat, terms) AS (VALUES ('brass', 'BRASS$', ['cu', 'zn']), ('steel', 'STEEL', ['fe']), ('small', '^SMALL', ['s'])), s AS (SELECT p_partkey AS session, CASE WHEN p_partkey % 10 = 0 THEN 'steel' WHEN p_partkey % 10 = 1 THEN 'lead' END AS explicit, nullif(p_type, 'x') AS title FROM part), h AS (SELECT session, profile, terms FROM s JOIN p ON explicit = profile UNION ALL SELECT session, profile, terms FROM s JOIN p ON explicit IS NULL AND regexp_matches(title, pat)), n AS (SELECT session, count(*) AS n, min(profile) AS profile, arg_min(terms, profile) AS terms FROM h GROUP BY 1) SELECT s.session, CASE WHEN n = 1 THEN 'ok' WHEN n > 1 THEN 'several' WHEN explicit IS NOT NULL THEN 'unknown' ELSE 'none' END AS status, CASE WHEN n = 1 THEN profile END AS profile, array_to_string(CASE WHEN n = 1 THEN list_concat(['all'], terms) WHEN n IS NULL AND explicit IS NULL THEN ['all'] END, ',') AS terms FROM s LEFT JOIN n USING (session)")
def matched_profiles(spark, sf_dir):
    p = Tables(spark, sf_dir).part
    kind = F.col("p_partkey") % 10
    s = p.select(F.col("p_partkey").alias("session"), F.when(kind == 0, "steel").when(kind == 1, "lead").alias("explicit"), F.col("p_type").alias("title"))
    profiles = spark.createDataFrame([("brass", "BRASS$", ["cu", "zn"]), ("steel", "STEEL", ["fe"]), ("small", "^SMALL", ["s"])], "profile string, match_title string, terms array<string>")
    return names.profile_match(s, profiles, F.array(F.lit("all"))).withColumn("terms", F.array_join("terms", ","))


@query("WITH t AS (SELECT c_nationkey AS k, c_custkey AS o, c_mktsegment || ' ' || c_custkey % 9 AS t FROM customer), d AS (SELECT k, min(o) AS o, arg_min(t, o) AS t FROM t GROUP BY k, lower(t)), s AS (SELECT *, 6 + 1 + sum(strlen(t) + 2) OVER (PARTITION BY k ORDER BY o) - 2 <= 200 AS f FROM d) SELECT k, 'Terms ' || string_agg(t, ', ' ORDER BY o) FILTER (f) || '.' AS prompt, count(*) FILTER (NOT f) AS dropped FROM s GROUP BY k")
def vocabulary_prompts(spark, sf_dir):
    c = Tables(spark, sf_dir).customer.select(F.col("c_nationkey").alias("k"), "c_custkey", F.concat("c_mktsegment", F.lit(" "), F.col("c_custkey") % 9).alias("term"))
    return names.vocabulary_prompt(c, ["k"], "c_custkey", "term", "Terms ", 200)


@query("WITH n AS (SELECT DISTINCT n_name AS name FROM nation), q AS (SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN ' ' WHEN 2 THEN left(n_name, 1) ELSE 'qqqqqqqqqqqqqqq' END AS typed FROM nation), p AS (SELECT k, name, CASE WHEN lower(name) = lower(trim(typed)) THEN 0 ELSE 1 END AS r FROM q, n WHERE trim(typed) <> '' AND (starts_with(lower(name), lower(trim(typed))) OR len(list_filter(string_split(lower(name), ' '), lambda w: starts_with(w, lower(trim(typed))))) > 0)), g AS (SELECT k, count(*) FILTER (r = 0) AS same, min(name) FILTER (r = 0) AS one, count(*) AS n FROM p GROUP BY 1) SELECT q.k, CASE WHEN trim(typed) = '' THEN 'blank' WHEN same = 1 THEN 'enrolled' WHEN n IS NULL THEN 'new' ELSE 'candidates' END AS result, CASE WHEN same = 1 THEN one WHEN n IS NULL AND trim(typed) <> '' THEN trim(typed) END AS name, CASE WHEN same <> 1 THEN n END AS n_candidates FROM q LEFT JOIN g USING (k)")
def resolved_names(spark, sf_dir):
    n = Tables(spark, sf_dir).nation
    k = F.col("n_nationkey") % 4
    typed = n.select(F.col("n_nationkey").alias("k"), F.when(k == 0, F.lower("n_name")).when(k == 1, " ").when(k == 2, F.left("n_name", F.lit(1))).otherwise("qqqqqqqqqqqqqqq").alias("typed"))
    found = names.resolve_names(typed, n.select(F.col("n_name").alias("name")), "k")
    return found.select("k", "result", "name", F.when(F.col("candidates").isNotNull(), F.size("candidates")).cast("long").alias("n_candidates"))


_CHANGE = "(SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'forget' WHEN 'signup' THEN 'deny' ELSE 'assign' END AS action, 'n' || event_id % 4 AS name FROM events)"


@query(f"WITH c AS (SELECT *, max(event_id) FILTER (action = 'forget') OVER (PARTITION BY user_id) AS f FROM {_CHANGE}), l AS (SELECT * FROM c WHERE action <> 'forget' AND event_id > coalesce(f, -1)) SELECT user_id, 'assigned' AS kind, arg_max(name, event_id) AS name FROM l WHERE action = 'assign' GROUP BY user_id UNION ALL SELECT user_id, 'denied', name FROM l GROUP BY user_id, name HAVING arg_max(action, event_id) = 'deny'")
def updated_labels(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    action = F.when(F.col("event_type") == "purchase", "forget").when(F.col("event_type") == "signup", "deny").otherwise("assign")
    return names.updated_labels(e.select("user_id", "event_id", action.alias("action"), F.concat(F.lit("n"), F.col("event_id") % 4).alias("name")), ["user_id"], "event_id")


@query("WITH g AS (SELECT embedding AS v, 3 AS keep FROM embeddings WHERE vec_id % 7 = 0), k AS (SELECT * FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.v = e.embedding AND e.label <> g.keep)) SELECT vec_id, label AS name, count(*) OVER (PARTITION BY label) AS remaining FROM k")
def forgotten_vectors(spark, sf_dir):
    e = _items(Tables(spark, sf_dir))
    return names.forget_vectors(e, e.filter("vec_id % 7 = 0").select("embedding", F.lit(3).alias("keep_name"))).select("vec_id", "name", "remaining")


@query(f"WITH v AS (SELECT session, id, first_s, 'spk' || label AS label FROM {_CL}), q AS (SELECT session, unnest(['spk1', 'spk2', CASE WHEN session = 3 THEN 'nobody' ELSE 'spk2' END]) AS label FROM (SELECT DISTINCT session FROM v)), j AS (SELECT q.session, id, first_s FROM (SELECT DISTINCT * FROM q) q LEFT JOIN v ON v.session = q.session AND v.label = q.label) SELECT session, CASE WHEN count(*) = count(id) THEN string_agg(id, ',' ORDER BY first_s, id) END AS members FROM j GROUP BY session")
def group_members(spark, sf_dir):
    v = Tables(spark, sf_dir).clusters().select("session", "id", "first_s", F.concat(F.lit("spk"), "label").alias("label"))
    asked = v.select("session").distinct().withColumn("label", F.explode(F.array(F.lit("spk1"), F.lit("spk2"), F.when(F.col("session") == 3, "nobody").otherwise("spk2"))))
    return names.group_members(asked, v, ["session"]).withColumn("members", F.array_join("members", ","))


@query(f"SELECT session, count(*) FILTER (named) AS left_named, count(*) FILTER (NOT named) AS left_unnamed FROM {_VOICES} WHERE id % 4 <> 0 GROUP BY session")
def unanswered_voices(spark, sf_dir):
    v = _voices(Tables(spark, sf_dir))
    return names.unanswered(v, v.filter("id % 4 = 0"), ["session"])


@query("WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'mic' ELSE 'speaker' END AS track, turn % 3 AS cluster, role AS speaker FROM conversations), l AS (SELECT DISTINCT conv_id, 1 AS id, 'Ann' AS label FROM conversations) SELECT t.conv_id, turn, CASE WHEN track = 'speaker' THEN coalesce(label, speaker) ELSE speaker END AS speaker, track = 'speaker' AND label IS NOT NULL AS changed FROM t LEFT JOIN l ON l.conv_id = t.conv_id AND l.id = t.cluster")
def relabelled_turns(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations
    t = c.select("conv_id", "turn", F.when(F.col("role") == "user", "mic").otherwise("speaker").alias("track"), (F.col("turn") % 3).alias("cluster"), F.col("role").alias("speaker"))
    l = c.select("conv_id").distinct().select("conv_id", F.lit(1).alias("id"), F.lit("Ann").alias("label"))  # noqa: E741
    return names.relabelled(t, l, ["conv_id"]).select("conv_id", "turn", "speaker", "changed")


_GRID = f"(SELECT user_id // 4 AS session, user_id % 4 AS slot, i AS frame, ((user_id * 31 + i * 17) % 101) / 100 AS p FROM {_FR})"


@query(f"WITH g AS {_GRID}, l AS (SELECT *, ln(greatest(1 - p, 1e-6)) AS q FROM g), a AS (SELECT *, CASE WHEN p > 0.5 THEN round(ln(greatest(p, 1e-6)) - q + sum(q) OVER (PARTITION BY session, frame) - ln(0.5), 9) END AS r FROM l), b AS (SELECT *, CASE WHEN r > 0 OR count(*) FILTER (r > 0) OVER (PARTITION BY session, slot) < 3 THEN r END AS s FROM a), c AS (SELECT *, round(s + CASE WHEN frame >= 24 THEN 0.05 ELSE 0 END, 9) AS s2 FROM b), d AS (SELECT *, round(s2 + CASE WHEN row_number() OVER (PARTITION BY session, slot ORDER BY s2 DESC NULLS LAST, frame) <= 4 THEN 2 * 0.6931471805599453 ELSE 0 END, 9) AS s3 FROM c), e AS (SELECT *, round(s3 + CASE WHEN row_number() OVER (PARTITION BY session, slot ORDER BY s3 DESC NULLS LAST, frame) <= 8 THEN 0.6931471805599453 ELSE 0 END, 9) AS s4 FROM d), f AS (SELECT session, slot, frame, s4 FROM e UNION ALL SELECT session, slot, NULL, 'inf'::DOUBLE FROM (SELECT DISTINCT session, slot FROM g), range(2)), h AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY s4 DESC NULLS LAST, slot, frame NULLS LAST) AS n FROM f) SELECT session, row_number() OVER (PARTITION BY session ORDER BY s4 IS NULL, slot, frame NULLS LAST, n) - 1 AS position, CASE WHEN s4 < 'inf'::DOUBLE THEN slot END AS slot, CASE WHEN s4 < 'inf'::DOUBLE THEN frame END AS frame FROM h WHERE n <= 24")
def compressed_cache(spark, sf_dir):
    g = _frames(spark, sf_dir).select(F.floor(F.col("user_id") / 4).alias("session"), (F.col("user_id") % 4).alias("slot"), F.col("i").alias("frame"), ((F.col("user_id") * 31 + F.col("i") * 17) % 101 / 100).alias("p"))
    return cache.compress(g, ["session"], "frame", "slot", "p", 24, 3, 4, 8, 0.05, 2)


@query(f"WITH c AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS n FROM {_TURNS}), g AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c), b AS (SELECT conv_id, run, min(speaker) AS sp, arg_min(start_s, turn) AS s, string_agg(text, ' ' ORDER BY turn) AS t FROM g GROUP BY conv_id, run) SELECT conv_id, string_agg('**' || sp || '** [' || printf('%02d:%02d', floor(s)::BIGINT // 60, floor(s)::BIGINT % 60) || '] ' || t, chr(10) || chr(10) ORDER BY run) AS markdown FROM b GROUP BY conv_id")
def markdown_transcripts(spark, sf_dir):
    return reports.markdown(_turns(Tables(spark, sf_dir)), ["conv_id"], "turn")


_CUE = "printf('%02d:%02d:%02d.%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"


@query(f"WITH t AS (SELECT *, round(start_s * 1000)::BIGINT AS ms, greatest(round(end_s * 1000), round(start_s * 1000) + 1)::BIGINT AS me, regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[\\r\\n]+', ' ', 'g') AS said FROM {_TURNS}) SELECT conv_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_CUE.format('ms')} || ' --> ' || {_CUE.format('me')} || chr(10) || '<v ' || speaker || '>' || said, chr(10) || chr(10) ORDER BY turn) || chr(10) AS vtt FROM t GROUP BY conv_id")
def vtt_transcripts(spark, sf_dir):
    return reports.web_vtt(_turns(Tables(spark, sf_dir)), ["conv_id"], "turn")


@query(f"SELECT conv_id, to_json({{'version': 1, 'conv_id': conv_id, 'rows': list({{'turn': turn, 'speaker': speaker, 'start_s': start_s, 'end_s': end_s, 'text': text}} ORDER BY turn)}})::VARCHAR AS report FROM {_TURNS} GROUP BY conv_id")
def json_reports(spark, sf_dir):
    return reports.json_report(_turns(Tables(spark, sf_dir)), ["conv_id"], "turn", 1, "turn", "speaker", "start_s", "end_s", "text")
