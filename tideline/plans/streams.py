"""Queries that replay tables as streams, with SQL that walks the same rows by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import assign, cache, intervals
from tideline.plans.catalog import _FR, Tables, _frames, query
from tideline.streaming import carried, grace, grouped, recording, replay

#: Parts of the time that a replay takes one after the other.
PARTS = 3
#: A key of its own, whose events only let time pass.
CLOSING = "~"
TRIES, WAIT_MS, GRACE_MS = 3, 3_600_000, 10_800_000

_EVENTS = "(SELECT user_id::VARCHAR AS k, epoch_us(ts) // 1000 AS ms, {kind} AS kind FROM events)"
_RECORDER = _EVENTS.format(kind="CASE WHEN event_id % 97 = 0 THEN 'Interrupt' ELSE ['Started', 'Ready', 'Stopped', 'Started', 'Idle', 'Ready', 'Started'][(event_id % 7 + 1)::INT] END")
_GRACE = _EVENTS.format(kind="CASE WHEN event_id % 89 = 0 THEN 'Interrupt' ELSE ['Started', 'Stopped', 'Stopped', 'Other'][(event_id % 4 + 1)::INT] END")


def _events(t: Tables, key: str, kind) -> list[DataFrame]:
    """Events as key, ts_ms, kind and ts, in parts of equal time and two that close."""
    ts = F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    e = t.events.select(F.col("user_id").cast("string").alias(key), F.floor(F.unix_micros(ts) / 1000).alias("ts_ms"), kind.alias("kind"), ts.alias("ts"))
    closing = t.spark.createDataFrame([(CLOSING, "Tick")], f"{key} string, kind string")
    return replay.by_time(e, "ts_ms", PARTS, closing)


def _one_of(names: list[str], n) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))


@query(
    f"WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ms, kind) AS n FROM {_RECORDER}),"
    f" w AS (SELECT k, 0::BIGINT AS n, 'watching' AS phase, NULL::BIGINT AS since, NULL::BIGINT AS late, NULL::BIGINT AS ms, NULL::VARCHAR AS event FROM (SELECT DISTINCT k FROM e)"
    f" UNION ALL SELECT k, n, CASE WHEN phase = 'exited' OR kind = 'Interrupt' THEN 'exited' WHEN phase = 'watching' AND kind = 'Started' THEN 'beginning' WHEN phase = 'beginning' AND kind = 'Ready' THEN 'recording' WHEN kind IN ('Stopped', 'Idle') THEN 'watching' ELSE phase END,"
    f" CASE WHEN phase = 'watching' AND kind = 'Started' THEN ms WHEN phase = 'beginning' AND kind NOT IN ('Ready', 'Stopped', 'Idle', 'Interrupt') THEN since END, late, ms,"
    f" CASE WHEN phase = 'beginning' AND kind = 'Ready' THEN 'began' WHEN phase = 'beginning' AND kind IN ('Stopped', 'Idle', 'Interrupt') THEN 'abandoned' WHEN phase = 'recording' AND kind IN ('Stopped', 'Idle', 'Interrupt') THEN 'ended' END"
    f" FROM (SELECT w.k, e.n, e.ms, e.kind, CASE WHEN w.phase = 'beginning' AND e.ms >= w.since + {TRIES * WAIT_MS} THEN 'watching' ELSE w.phase END AS phase, w.since, CASE WHEN w.phase = 'beginning' AND e.ms >= w.since + {TRIES * WAIT_MS} THEN w.since + {TRIES * WAIT_MS} END AS late FROM w JOIN e ON e.k = w.k AND e.n = w.n + 1))"
    f" SELECT k AS device, ms AS at_ms, event FROM w WHERE event IS NOT NULL UNION ALL SELECT k, late, 'abandoned' FROM w WHERE late IS NOT NULL"
    f" UNION ALL SELECT k, since + {TRIES * WAIT_MS}, 'abandoned' FROM w JOIN (SELECT k, max(n) AS n FROM e GROUP BY k) USING (k, n) WHERE phase = 'beginning'"
)
def recorder_states(spark, sf_dir):
    """Each user is a recorder; what no event settles in time, the deadline does."""
    kind = F.when(F.col("event_id") % 97 == 0, "Interrupt").otherwise(_one_of(["Started", "Ready", "Stopped", "Started", "Idle", "Ready", "Started"], F.col("event_id") % 7))
    parts = _events(Tables(spark, sf_dir), "device", kind)
    groups = grouped.groups_for(Tables(spark, sf_dir).events, "user_id")
    return replay.replayed(parts, lambda s: recording.recorder_stream(s, TRIES, WAIT_MS, groups=groups))


@query(
    f"WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ms, kind) AS n FROM {_GRACE}),"
    f" w AS (SELECT k, 0::BIGINT AS n, NULL::BIGINT AS started, NULL::BIGINT AS stopped, NULL::BIGINT AS s1, NULL::BIGINT AS e1, NULL::BIGINT AS s2, NULL::BIGINT AS e2 FROM (SELECT DISTINCT k FROM e)"
    f" UNION ALL SELECT k, n, CASE WHEN kind = 'Started' THEN coalesce(started, ms) WHEN kind = 'Interrupt' THEN NULL ELSE started END, CASE WHEN kind = 'Stopped' AND started IS NOT NULL THEN coalesce(stopped, ms) WHEN kind IN ('Started', 'Interrupt') THEN NULL ELSE stopped END,"
    f" s1, e1, CASE WHEN kind = 'Interrupt' THEN started END, CASE WHEN kind = 'Interrupt' AND started IS NOT NULL THEN ms END"
    f" FROM (SELECT w.k, e.n, e.ms, e.kind, CASE WHEN NOT over THEN w.started END AS started, CASE WHEN NOT over THEN w.stopped END AS stopped, CASE WHEN over THEN w.started END AS s1, CASE WHEN over THEN w.stopped END AS e1 FROM (SELECT w.*, e.ms, e.kind, e.n AS m, coalesce(w.started IS NOT NULL AND e.ms >= w.stopped + {GRACE_MS}, false) AS over FROM w JOIN e ON e.k = w.k AND e.n = w.n + 1) w JOIN e ON e.k = w.k AND e.n = w.m))"
    f" SELECT k AS key, s1 AS started_ms, e1 AS ended_ms, 'stopped' AS reason FROM w WHERE s1 IS NOT NULL UNION ALL SELECT k, s2, e2, 'interrupt' FROM w WHERE s2 IS NOT NULL"
    f" UNION ALL SELECT k, started, stopped, 'stopped' FROM w JOIN (SELECT k, max(n) AS n FROM e GROUP BY k) USING (k, n) WHERE stopped IS NOT NULL"
)
def grace_stream_sessions(spark, sf_dir):
    kind = F.when(F.col("event_id") % 89 == 0, "Interrupt").otherwise(_one_of(["Started", "Stopped", "Stopped", "Other"], F.col("event_id") % 4))
    parts = _events(Tables(spark, sf_dir), "key", kind)
    groups = grouped.groups_for(Tables(spark, sf_dir).events, "user_id")
    return replay.replayed(parts, lambda s: grace.grace_stream(s, GRACE_MS, groups=groups))


#: Frames of a chunk, and a rule small enough that the proxies' sessions compress their caches again and again.
CHUNK_FRAMES = 12
RULE = carried.CacheRule(slots=4, queue=10, at_least=6, capacity=16, least=2, strong=2, weak=4, silence=1)


def cache_chunks(spark, sf_dir) -> DataFrame:
    """Four users are the slots of a session; a chunk also has new estimates of the eight frames before it."""
    f = _frames(spark, sf_dir).select(F.floor(F.col("user_id") / 4).alias("session"), (F.col("user_id") % 4).cast("int").alias("slot"), F.col("i").cast("long").alias("frame"))
    wide = f.groupBy("session", "frame").agg(F.collect_set("slot").alias("slots"))
    own = F.floor(F.col("frame") / CHUNK_FRAMES)
    again = wide.withColumn("chunk", F.explode(F.when(F.col("frame") % CHUNK_FRAMES >= CHUNK_FRAMES - 8, F.array(own, own + 1)).otherwise(F.array(own))))
    last = again.groupBy("session").agg(F.max(F.floor(F.col("frame") / CHUNK_FRAMES)).alias("_last"))
    p = [F.when(F.array_contains("slots", s), ((F.col("session") * 4 + s) * 31 + F.col("frame") * 17 + F.col("chunk") * 3) % 101 / 100).otherwise(0.0) for s in range(4)]
    return again.join(last, "session").filter("chunk <= _last").select("session", "chunk", "frame", F.array(*p).alias("probs"))


@query()
def carried_cache(spark, sf_dir):
    """The last queue and cache of each session, carried over chunks that arrive in three batches."""
    chunks = cache_chunks(spark, sf_dir)
    parts = [chunks.filter("chunk < 2"), chunks.filter("chunk >= 2 AND chunk < 4"), chunks.filter("chunk >= 4")]
    groups = grouped.groups_for(chunks, "session")
    states = carried.last_states(replay.replayed(parts, lambda s: carried.cache_stream(s, RULE, groups)))
    return states.select("session", "chunk", "part", "position", "frame", F.transform("probs", lambda x: F.round(x, 6)).alias("probs"))


def offers(t: Tables) -> DataFrame:
    """A name for each label and block of 200 ids, so that names grow in number with the table and not in offers."""
    name = F.concat(F.lit("spk"), "label", F.lit("-"), F.floor(F.col("vec_id") / 200))
    clip = F.when(F.col("vec_id") % 11 != 0, ((F.col("vec_id") * 7919) % 97).cast("double"))
    return t.embeddings.select(name.alias("name"), F.col("vec_id").alias("ord"), "embedding", clip.alias("clip_s"))


_OFFERS = "(SELECT 'spk' || label || '-' || vec_id // 200 AS name, vec_id AS ord, md5(array_to_string(embedding, ',')) AS v, CASE WHEN vec_id % 11 <> 0 THEN (vec_id * 7919 % 97)::DOUBLE END AS clip FROM embeddings)"
_HELD = (
    f"WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord) AS n FROM {_OFFERS}),"
    " w AS (SELECT name, 0::BIGINT AS n, []::STRUCT(clip DOUBLE, ord BIGINT, v VARCHAR)[] AS held FROM (SELECT DISTINCT name FROM o)"
    " UNION ALL SELECT name, n, CASE WHEN known THEN held WHEN len(held) < 4 THEN list_append(held, offer) WHEN least IS NOT NULL AND offer.clip > least.clip THEN list_append(list_filter(held, lambda h: h.ord <> least.ord), offer) ELSE held END"
    " FROM (SELECT w.name, o.n, w.held, {'clip': o.clip, 'ord': o.ord, 'v': o.v} AS offer, len(list_filter(w.held, lambda h: h.v = o.v)) > 0 AS known, list_sort(list_filter(w.held, lambda h: h.clip IS NOT NULL))[1] AS least FROM w JOIN o ON o.name = w.name AND o.n = w.n + 1))"
    " SELECT name, h.ord AS ord, h.clip AS clip_s FROM (SELECT name, unnest(arg_max(held, n)) AS h FROM w GROUP BY name)"
)


@query(_HELD)
def bounded_references(spark, sf_dir):
    return assign.reservoir(offers(Tables(spark, sf_dir)), 4)


@query(_HELD)
def bounded_references_stream(spark, sf_dir):
    """The same offers in three batches, each taken up after a restart."""
    o = offers(Tables(spark, sf_dir)).select("name", "ord", F.xxhash64("embedding").alias("vector"), "clip_s")
    parts = [o.filter(F.pmod("ord", F.lit(200)) < 70), o.filter(F.pmod("ord", F.lit(200)).between(70, 139)), o.filter(F.pmod("ord", F.lit(200)) >= 140)]
    return carried.last_references(replay.replayed(parts, lambda s: carried.references_stream(s, 4)))


_PIECES = "(SELECT conv_id AS session, CASE WHEN turn % 2 = 0 THEN 'speaker' ELSE 'mic' END AS track, turn, (turn % 4 + 1) * 0.5 AS size FROM conversations WHERE turn % 2 = 0 OR conv_id % 3 <> 0)"


@query(f"SELECT session, track, turn, coalesce(sum(size + 0.5) OVER (PARTITION BY session, track ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS placed_s, size::DOUBLE AS length_s, false AS silent FROM {_PIECES} UNION ALL SELECT DISTINCT conv_id, 'mic', NULL, 0, 1, true FROM conversations WHERE conv_id NOT IN (SELECT session FROM {_PIECES} WHERE track = 'mic')")
def built_tracks(spark, sf_dir):
    """Even turns are a session's speaker track, odd ones its mic track; every third session has no mic."""
    c = Tables(spark, sf_dir).conversations
    pieces = c.filter("turn % 2 = 0 OR conv_id % 3 <> 0").select(F.col("conv_id").alias("session"), F.when(F.col("turn") % 2 == 0, "speaker").otherwise("mic").alias("track"), "turn", ((F.col("turn") % 4 + 1) * 0.5).alias("size"))
    return intervals.built_tracks(c.select(F.col("conv_id").alias("session")), pieces, "turn", "size")


@query(f"WITH l AS (SELECT user_id // 4 AS session, user_id % 4 AS slot, i, ((user_id * 31 + i * 17) % 41 - 20) / 4 AS x FROM {_FR}) SELECT session, i // 3 AS frame, slot, round(avg(1 / (1 + exp(-x))), 6) AS p FROM l GROUP BY ALL HAVING count(*) = 3")
def pooled_frames(spark, sf_dir):
    """Three frames of a slot pooled to one."""
    l = _frames(spark, sf_dir).select(F.floor(F.col("user_id") / 4).alias("session"), (F.col("user_id") % 4).alias("slot"), "i", (((F.col("user_id") * 31 + F.col("i") * 17) % 41 - 20) / 4).alias("x"))
    return cache.pooled(l, ["session"], "i", "slot", "x", 3).select("session", F.col("i").alias("frame"), "slot", F.round("p", 6).alias("p"))
