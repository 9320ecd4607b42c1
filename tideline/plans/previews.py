"""Queries over what answers would store and the documents that tell of it, with their SQL. Registered with the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import assign, outcomes, voices
from tideline.operators.lineage import checkpointed
from tideline.plans import answers
from tideline.plans.catalog import COLLECTION, Tables, _awarded, _tentative, query
from tideline.plans.sessions import _VOICES, _voices
from tideline.plans.streams import _OFFERS, offers
from tideline.sources import reports

#: References that a name of the proxies may hold, by the query.
MOST, MOST_HELD = 13, 10
_REFS = f"(SELECT * FROM {_OFFERS} WHERE ord % 3 <> 0)"
_ASKED = "(SELECT vec_id // 200 AS session, vec_id AS id, CASE vec_id % 4 WHEN 0 THEN 'spk' || label || '-' || vec_id // 200 WHEN 1 THEN 'new' || vec_id ELSE 'spk' || vec_id % 10 || '-' || vec_id // 200 END AS name, md5(array_to_string(embedding, ',')) AS v, (vec_id * 31 % 101)::DOUBLE AS speech_s FROM embeddings WHERE vec_id % 7 = 0)"


def asked(t: Tables) -> DataFrame:
    """Every seventh vector is answered with its own name, a new one or another of its block of 200 ids."""
    block, i = F.floor(F.col("vec_id") / 200), F.col("vec_id")
    name = F.when(i % 4 == 0, F.concat(F.lit("spk"), "label", F.lit("-"), block)).when(i % 4 == 1, F.concat(F.lit("new"), i)).otherwise(F.concat(F.lit("spk"), i % 10, F.lit("-"), block))
    return t.embeddings.filter(i % 7 == 0).select(block.alias("session"), i.alias("id"), name.alias("name"), "embedding", (i * 31 % 101).cast("double").alias("speech_s"))


def references(t: Tables) -> DataFrame:
    return offers(t).filter("ord % 3 <> 0")


@query(
    f"WITH r AS {_REFS}, a AS {_ASKED}, h AS (SELECT name, count(*) AS n, min(clip) AS least FROM r GROUP BY 1),"
    " x AS (SELECT a.id, r.name, h.n - count(*) AS remaining FROM a JOIN r USING (v) JOIN h ON h.name = r.name GROUP BY a.id, r.name, h.n),"
    " s AS (SELECT a.*, coalesce(h.n, 0) AS n, least, speech_s >= 5 AS kept, EXISTS (SELECT 1 FROM x WHERE x.id = a.id AND x.name = a.name) AS known FROM a LEFT JOIN h USING (name)),"
    f" o AS (SELECT *, CASE WHEN NOT kept THEN NULL WHEN known THEN 'already_held' WHEN n = 0 THEN 'enrolled' WHEN n < {MOST} THEN 'added' WHEN speech_s > least THEN 'replaced' ELSE 'at_capacity' END AS stored FROM s)"
    " SELECT session, id, name, stored, CASE stored WHEN 'added' THEN n + 1 WHEN 'replaced' THEN n WHEN 'at_capacity' THEN n END AS held, CASE stored WHEN 'replaced' THEN least END AS evicted_s, CASE stored WHEN 'at_capacity' THEN least END AS shortest_s,"
    " stored IS NULL OR stored = 'at_capacity' AS session_only, CASE WHEN kept THEN (SELECT string_agg(x.name || ':' || remaining, ',' ORDER BY x.name) FROM x WHERE x.id = o.id AND x.name <> o.name) END AS displaced,"
    " CASE WHEN NOT kept THEN (SELECT string_agg(x.name, ',' ORDER BY x.name) FROM x WHERE x.id = o.id AND x.name <> o.name) END AS stale FROM o"
)
def stored_outcomes(spark, sf_dir):
    """What each answer would store, and which names would lose a reference or keep a stale one."""
    t = Tables(spark, sf_dir)
    lost = F.array_join(F.transform("displaced", lambda d: F.concat_ws(":", d["name"], d["remaining"].cast("string"))), ",")
    o = outcomes.outcomes(asked(t), references(t), ["session"], MOST)
    return o.withColumn("displaced", F.nullif(lost, F.lit(""))).withColumn("stale", F.nullif(F.array_join("stale", ","), F.lit("")))


_LISTED = (
    f"WITH v AS (SELECT *, 'Unknown ' || row_number() OVER (PARTITION BY session ORDER BY first_s, id) AS number FROM {_VOICES}),"
    " c AS (SELECT *, max(speech_s >= 5) OVER (PARTITION BY session) AS a FROM v),"
    " q AS (SELECT *, CASE WHEN named THEN CASE WHEN id % 2 = 0 THEN 'Ann' ELSE 'Ben?' END ELSE number END AS label FROM c WHERE speech_s >= 5 OR NOT a),"
    f" k AS (SELECT id, name, max(sim)::DECIMAL(9,6) AS sim, count(*) AS n FROM {answers._SIMS} WHERE id % 2 = 0 GROUP BY ALL),"
)
_MEETING = "CASE WHEN session % 3 = 0 THEN 'Meeting ' || session END"


def listed(t: Tables) -> DataFrame:
    """session, report and lines of all voices that can be asked about, named ones too; odd ids sound like nobody."""
    v = voices.unknown_numbers(_voices(t), ["session"]).withColumnRenamed("label", "number")
    shown = F.when(F.col("named"), F.when(F.col("id") % 2 == 0, "Ann").otherwise("Ben?")).otherwise(F.col("number"))
    v = voices.prompt_queue(v, ["session"], with_named=True).withColumn("label", shown)
    like = answers._ranked(t).filter("id % 2 = 0").groupBy("session", "id", "name").agg(F.max("similarity").cast("decimal(9,6)").alias("similarity"), F.count("*").alias("n_references"))
    meetings = v.filter("session % 3 = 0").select("session").distinct().withColumn("meeting", F.concat(F.lit("Meeting "), "session"))
    return reports.voice_lists(v, like, meetings)


@query(
    _LISTED + " w AS (SELECT id, string_agg('{\"name\":' || to_json(name) || ',\"similarity\":' || sim || ',\"references\":' || n || '}', ',' ORDER BY sim DESC, name) AS found FROM k GROUP BY 1),"
    " d AS (SELECT session, string_agg('{\"number\":' || to_json(number) || ',\"label\":' || to_json(label) || ',\"speech_seconds\":' || speech_s::DOUBLE || ',\"candidates\":[' || coalesce(found, '') || ']}', ',' ORDER BY first_s, q.id) AS voices FROM q LEFT JOIN w USING (id) GROUP BY 1)"
    f" SELECT session, '{{\"schema\":\"voices.list.v1\",\"sessions\":[{{\"id\":\"' || session || '\",\"meeting\":' || coalesce('\"' || {_MEETING} || '\"', 'null') || ',\"voices\":[' || voices || ']}}]}}' AS report FROM d"
)
def voice_lists(spark, sf_dir):
    return listed(Tables(spark, sf_dir)).select("session", "report")


@query(
    _LISTED + " w AS (SELECT id, string_agg(chr(10) || '    ' || rpad(name, greatest(20, length(name))::INT, ' ') || ' ' || printf('%6.2f', sim::DOUBLE) || '  ' || printf('%2d ref', n), '' ORDER BY sim DESC, name) AS found FROM k GROUP BY 1)"
    " SELECT session, string_agg(session || '  ' || CASE WHEN label = number THEN 'who is ' || number || '?' WHEN label LIKE '%?' THEN 'is ' || number || ' ' || label ELSE 'is ' || number || ' ' || label || '?' END"
    " || '  ' || round(speech_s)::BIGINT || 's of speech' || coalesce(found, ''), chr(10) || chr(10) ORDER BY first_s, q.id) AS lines FROM q LEFT JOIN w USING (id) GROUP BY 1"
)
def voice_list_lines(spark, sf_dir):
    return listed(Tables(spark, sf_dir)).select("session", "lines")


def named(t: Tables) -> DataFrame:
    """Every 17th cluster is named like one of three references; each answer is judged for itself."""
    c = t.clusters().filter("id % 17 = 0")
    return c.select("session", F.col("id").alias("grp"), "id", F.concat(F.lit("spk"), F.col("id") % 3).alias("name"), "first_s", F.lit(False).alias("authority"))


def held(t: Tables) -> DataFrame:
    """The references by name, and every 34th cluster under a name of its block that it is not."""
    late = F.concat(F.lit("late"), F.floor(F.col("session") / COLLECTION))
    wrong = t.clusters().filter("id % 34 = 0").select(late.alias("name"), "embedding", F.lit(3.0).alias("clip_s"))
    return t.references().select("name", "embedding", (F.col("vec_id") % 9 + 1).cast("double").alias("clip_s")).unionByName(wrong)


@query()
def answer_documents(spark, sf_dir):
    """What naming every 17th cluster would do, as a document and as lines: its verdict among the session's labels, and what is stored."""
    t = Tables(spark, sf_dir)
    c, hand, sure, guessed, edges = t.clusters(), checkpointed(answers._hand(t)), checkpointed(_awarded(t)), checkpointed(_tentative(t)), t.conflicts()
    none = hand.limit(0).select("session", "id", "name")
    plain = lambda df: df.select("session", "id", "name")
    judged = assign.walked_answers(named(t), c, hand.withColumn("ord", F.lit(0)), plain(sure), plain(guessed), none, edges, ["session"]).drop("grp", "overridden")
    before = assign.labels(c, none, hand, sure, guessed, none, edges, ["session"]).select("session", F.col("id").alias("other"), F.col("label").alias("losing"))
    numbers = voices.unknown_numbers(c, ["session"]).select("session", "id", F.col("label").alias("number"), "embedding", "speech_s")
    other = numbers.select("session", F.col("id").alias("other"), F.col("number").alias("other_number"))
    given = checkpointed(judged.join(numbers, ["session", "id"]))
    facts = given.select("session", "id", "number", "verdict", "other").join(other, ["session", "other"], "left").join(before, ["session", "other"], "left")
    return reports.dry_runs(outcomes.outcomes(given, held(t), ["session"], MOST_HELD).join(facts, ["session", "id"]), ["session"])
