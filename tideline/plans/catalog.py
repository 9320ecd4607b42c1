"""Every registered query of the core operators with its DuckDB SQL, over proxy tables (see README)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.functions import vectors as V
from tideline.operators import assign, intervals, names, segments, stats
from tideline.operators import vectors as vec
from tideline.operators.lineage import checkpointed

_QUERIES: dict = {}
_SQL: dict[str, str] = {}

#: Ids of one session, and sessions of one collection of trials: as many of them as the table needs, each of bounded size.
SESSION_IDS, COLLECTION = 40, 10
#: Vectors under this id are named references, the others probes; distances of the proxy vectors need this cut.
REFERENCES, CUT, LOOSE = 100, 0.70, 0.75
EVENTS = "(SELECT *, (epoch_us(ts) // 1000000)::BIGINT AS s FROM events)"


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries():
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


class Tables:
    """Proxy tables that several queries use."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def events_s(self) -> DataFrame:
        """Adds s: ts as seconds since 1970, its clock read as UTC whatever the session's zone."""
        return self.events.withColumn("s", F.unix_seconds(F.from_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())))

    def references(self) -> DataFrame:
        return self.embeddings.filter(F.col("vec_id") < REFERENCES).select(F.concat(F.lit("spk"), "label").alias("name"), "vec_id", "embedding")

    def probes(self) -> DataFrame:
        return self.embeddings.filter(F.col("vec_id") >= REFERENCES)

    def clusters(self) -> DataFrame:
        """session (SESSION_IDS ids each), id, speech seconds and first appearance."""
        session = F.floor(F.col("vec_id") / SESSION_IDS)
        return self.probes().select(session.alias("session"), F.col("vec_id").alias("id"), ((F.col("vec_id") % 13) + 0.5).alias("speech_s"), (F.col("vec_id") * 7 % 101).cast("double").alias("first_s"), "embedding", "label")

    def conflicts(self) -> DataFrame:
        c = self.clusters().select("session", F.col("id").alias("a"))
        pairs = c.filter(F.col("a") % 4 == 0).select("session", "a", (F.col("a") + 3).alias("b"))
        return pairs.filter(F.floor(F.col("b") / SESSION_IDS) == F.col("session"))

    def slots(self) -> DataFrame:
        """Ten users are the slots of a session; their events are its turns."""
        e = self.events_s()
        return e.select(F.floor(F.col("user_id") / 10).alias("session"), F.col("event_id").alias("seq"), (F.col("user_id") % 10).alias("cluster"), F.col("s").alias("start_s"), (F.col("s") + F.floor("value") * 10 + 1).cast("long").alias("end_s"))


_REF = f"(SELECT 'spk' || label AS name, vec_id AS ref, embedding AS rv FROM embeddings WHERE vec_id < {REFERENCES})"
_SIM = f"(SELECT p.vec_id, r.name, list_inner_product(p.embedding::DOUBLE[], r.rv::DOUBLE[]) AS sim FROM embeddings p, {_REF} r WHERE p.vec_id >= {REFERENCES})"


@query(f"SELECT vec_id, name, round(sim, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, name) AS n FROM {_SIM}) WHERE n = 1 AND 1 - sim < {CUT}")
def nearest_reference(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return vec.nearest_name(t.probes(), t.references(), CUT).withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT vec_id, name, n_references, round(sim, 6) AS similarity, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, name) AS rank FROM (SELECT vec_id, name, max(sim) AS sim FROM {_SIM} GROUP BY ALL) JOIN (SELECT name, count(*) AS n_references FROM {_REF} GROUP BY name) USING (name)")
def ranked_references(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return vec.ranked_names(t.probes(), t.references()).withColumn("similarity", F.round("similarity", 6))


@query("SELECT label, i, round(m / len, 6) AS unit, round(len, 6) AS length FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY label)) AS len FROM (SELECT label, i, avg(x::DOUBLE) AS m FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding) AS x FROM embeddings) GROUP BY ALL))")
def group_mean_vectors(spark, sf_dir):
    m = vec.group_means(Tables(spark, sf_dir).embeddings, ["label"])
    return m.select("label", F.posexplode("unit").alias("i", "unit"), "length").select("label", "i", F.round("unit", 6).alias("unit"), F.round("length", 6).alias("length"))


_CL = f"(SELECT vec_id // {SESSION_IDS} AS session, vec_id AS id, vec_id % 13 + 0.5 AS speech_s, (vec_id * 7 % 101)::DOUBLE AS first_s, embedding, label FROM embeddings WHERE vec_id >= {REFERENCES})"
_EDGE = f"(SELECT session, id AS a, id + 3 AS b FROM {_CL} WHERE id % 4 = 0 AND (id + 3) // {SESSION_IDS} = session)"
_BOTH = f"(SELECT session, a, b FROM {_EDGE} UNION SELECT session, b, a FROM {_EDGE})"


@query(f"SELECT c.session, c.id, o.id AS other, round(1 - list_inner_product(c.embedding::DOUBLE[], o.embedding::DOUBLE[]), 6) AS distance, e.a IS NOT NULL AS conflict FROM {_CL} c JOIN {_CL} o ON c.session = o.session AND c.id <> o.id LEFT JOIN {_BOTH} e ON e.a = c.id AND e.b = o.id WHERE c.speech_s < 5")
def fragment_pairs(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return vec.directed_pairs(t.clusters(), t.conflicts(), F.col("speech_s") < 5, ["session"]).withColumn("distance", F.round("distance", 6))


@query("WITH l AS (SELECT vec_id AS label_id, embedding FROM embeddings WHERE vec_id % 3 = 0) SELECT label_id, min(e.vec_id) AS vec_id FROM l JOIN embeddings e ON l.embedding = e.embedding GROUP BY label_id HAVING count(*) = 1")
def labels_by_exact_vector(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return vec.unique_vector_matches(t.embeddings.select("vec_id", "embedding"), t.embeddings.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("label_id"), "embedding"), "vec_id", "label_id")


_PAIRS = f"(SELECT a.session // {COLLECTION} AS collection, a.session = b.session AS excluded, a.label = b.label AS same, CASE WHEN a.session <> b.session THEN round(1 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) END AS distance FROM {_CL} a JOIN {_CL} b ON a.id > b.id AND a.session // {COLLECTION} = b.session // {COLLECTION})"
_TRIALS = f"(SELECT same, distance FROM {_PAIRS} WHERE NOT excluded)"


def _trials(spark, sf_dir) -> DataFrame:
    return _pairs(spark, sf_dir).filter("NOT excluded").select("same", "distance")


def _pairs(spark, sf_dir) -> DataFrame:
    c = Tables(spark, sf_dir).clusters().withColumn("collection", F.floor(F.col("session") / COLLECTION))
    return vec.trial_pairs(c, ["collection"], "session", "id", "label").withColumn("distance", F.round("distance", 6))


@query(f"SELECT collection, count(*) FILTER (excluded) AS excluded, count(*) FILTER (NOT excluded) AS trials, count(*) FILTER (NOT excluded AND same) AS same FROM {_PAIRS} GROUP BY collection")
def trial_exclusions(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy("collection").agg(F.count_if("excluded").alias("excluded"), F.count_if(~F.col("excluded")).alias("trials"), F.count_if(~F.col("excluded") & F.col("same")).alias("same"))


@query(f"SELECT same, count(*) AS n, min(distance) AS least, quantile_disc(distance, 0.05) AS p05, round(median(distance), 6) AS median, quantile_disc(distance, 0.95) AS p95, max(distance) AS most, round(avg(distance), 6) AS mean FROM {_TRIALS} GROUP BY same")
def trial_spread(spark, sf_dir):
    return stats.spread(_trials(spark, sf_dir), ["same"], "distance").withColumn("mean", F.round("mean", 6)).withColumn("median", F.round("median", 6))


@query(f"SELECT *, false_accepts / nullif(n_different, 0) AS accept_rate, false_rejects / nullif(n_same, 0) AS reject_rate FROM (SELECT count(*) FILTER (NOT same) AS n_different, count(*) FILTER (NOT same AND distance < 0.9) AS false_accepts, count(*) FILTER (same) AS n_same, count(*) FILTER (same AND distance >= 0.9) AS false_rejects, min(distance) FILTER (NOT same) AS zero_accept_cut, max(distance) FILTER (same) AS most_same FROM {_TRIALS})")
def trial_error_rates(spark, sf_dir):
    return stats.error_rates(_trials(spark, sf_dir), 0.9)


@query(f"WITH t AS {_TRIALS}, d AS (SELECT distance AS cut, count(*) FILTER (same) AS s, count(*) FILTER (NOT same) AS x FROM t GROUP BY 1), r AS (SELECT cut, (sum(x) OVER w - x) / sum(x) OVER () AS fa, 1 - (sum(s) OVER w - s) / sum(s) OVER () AS fr FROM d WINDOW w AS (ORDER BY cut)) SELECT cut, round((fa + fr) / 2, 9) AS rate FROM r ORDER BY round(abs(fa - fr), 12), fa + fr, cut LIMIT 1")
def trial_equal_error(spark, sf_dir):
    return stats.equal_error(_trials(spark, sf_dir)).withColumn("rate", F.round("rate", 9))


@query("SELECT quality, n, k, round(CASE WHEN k = 0 THEN 0 ELSE (k/n + 1.96*1.96/(2*n) - 1.96*sqrt(k/n*(1-k/n)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n) END, 9) AS low, round(CASE WHEN k = n THEN 1 ELSE (k/n + 1.96*1.96/(2*n) + 1.96*sqrt(k/n*(1-k/n)/n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n) END, 9) AS high FROM (SELECT quality, count(*)::DOUBLE AS n, sum(toxic)::DOUBLE AS k FROM labels GROUP BY quality)")
def toxic_share_intervals(spark, sf_dir):
    g = Tables(spark, sf_dir).labels.groupBy("quality").agg(F.count("*").cast("double").alias("n"), F.sum("toxic").cast("double").alias("k"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return g.select("quality", "n", "k", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


_SLOTS = f"(SELECT user_id // 10 AS session, event_id AS seq, user_id % 10 AS cluster, s AS start_s, (s + floor(value) * 10 + 1)::BIGINT AS end_s FROM {EVENTS})"


@query(f"WITH g AS (SELECT session, seq, start_s, start_s + 600 AS end_s FROM {_SLOTS} WHERE seq % 2 = 1), t AS (SELECT * FROM {_SLOTS} WHERE seq % 2 = 0), p AS (SELECT g.session, g.seq, g.start_s, g.end_s, t.cluster, sum(greatest(least(g.end_s, t.end_s) - greatest(g.start_s, t.start_s), 0)) AS o, min(greatest(t.start_s - g.end_s, g.start_s - t.end_s, 0)) AS gap FROM g LEFT JOIN t ON g.session = t.session GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY session, seq ORDER BY o DESC, CASE WHEN o > 0 THEN 0 ELSE gap END, cluster) AS n FROM p) SELECT session, seq, start_s, end_s, cluster, o::DOUBLE AS overlap_s, CASE WHEN o > 0 THEN 0 ELSE gap END::DOUBLE AS gap_s FROM r WHERE n = 1")
def overlap_attribution(spark, sf_dir):
    s = Tables(spark, sf_dir).slots()
    segs = s.filter("seq % 2 = 1").select("session", "seq", "start_s", (F.col("start_s") + 600).alias("end_s"))
    return intervals.overlap_attribution(segs, s.filter("seq % 2 = 0").drop("seq"), ["session"]).withColumn("overlap_s", F.col("overlap_s").cast("double"))


@query(f"WITH p AS (SELECT user_id, event_id AS probe, s AS at_s FROM {EVENTS} WHERE event_type = 'signup'), e AS (SELECT user_id, event_id, s AS start_s, (s + floor(value) * 60)::BIGINT AS end_s FROM {EVENTS} WHERE event_type = 'purchase'), c AS (SELECT p.probe, e.*, at_s, CASE WHEN start_s <= at_s AND at_s < end_s THEN 1 WHEN start_s > at_s AND start_s - at_s <= 86400 THEN 2 WHEN end_s <= at_s AND at_s - end_s <= 86400 THEN 3 END AS tier FROM p JOIN e ON p.user_id = e.user_id), b AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY tier, CASE tier WHEN 1 THEN end_s - start_s WHEN 2 THEN start_s ELSE -end_s END, start_s, event_id) AS n FROM c WHERE tier IS NOT NULL) SELECT p.user_id, p.probe, p.at_s, b.event_id, CASE WHEN b.tier = 1 AND p.at_s - b.start_s <= 86400 THEN 'started' WHEN b.tier = 1 THEN 'joined_late' WHEN b.tier = 2 THEN 'started_early' WHEN b.tier = 3 THEN 'after_end' END AS fit FROM p LEFT JOIN b ON p.probe = b.probe AND b.n = 1")
def asof_events(spark, sf_dir):
    e = Tables(spark, sf_dir).events_s()
    probes = e.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("probe"), F.col("s").alias("at_s"))
    found = e.filter("event_type = 'purchase'").select("user_id", "event_id", F.col("s").alias("start_s"), (F.col("s") + F.floor("value") * 60).cast("long").alias("end_s"))
    return intervals.asof_tiers(probes, found, ["user_id"], "probe", 86400)


@query(f"SELECT DISTINCT a.session, a.cluster AS slot, b.cluster AS other FROM {_SLOTS} a JOIN {_SLOTS} b ON a.session = b.session AND a.start_s < b.end_s AND b.start_s < a.end_s AND a.cluster <> b.cluster")
def heard_at_once(spark, sf_dir):
    return intervals.overlapping_slots(Tables(spark, sf_dir).slots().withColumnRenamed("cluster", "slot"), ["session"])


@query("WITH t AS (SELECT conv_id, turn AS seq, turn * 7.5 AS start_s, turn * 7.5 + 6 AS end_s, CASE WHEN role = 'user' THEN NULL ELSE (turn % 3)::BIGINT END AS cluster FROM conversations), p AS (SELECT conv_id, unnest(range(0, 40, 3)) AS at_s FROM (SELECT DISTINCT conv_id FROM conversations)), c AS (SELECT p.*, t.seq, t.cluster, t.start_s, CASE WHEN floor(start_s) = at_s THEN 1 WHEN start_s <= at_s AND at_s < end_s THEN 2 END AS tier FROM p JOIN t USING (conv_id)), b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, at_s ORDER BY tier, start_s, seq) AS n, count(DISTINCT cluster) OVER (PARTITION BY conv_id, at_s) AS voices FROM c WHERE tier IS NOT NULL), m AS (SELECT conv_id, max(end_s) AS last FROM t GROUP BY 1) SELECT p.conv_id, p.at_s, CASE WHEN b.cluster IS NOT NULL THEN 'cluster' WHEN b.n IS NOT NULL THEN 'no_cluster' WHEN p.at_s >= m.last THEN 'past_end' ELSE 'silence' END AS result, b.cluster, b.seq, coalesce(b.voices, 0) AS voices, coalesce(h.heard, '') AS heard FROM p LEFT JOIN b ON p.conv_id = b.conv_id AND p.at_s = b.at_s AND b.n = 1 LEFT JOIN m ON p.conv_id = m.conv_id LEFT JOIN (SELECT conv_id, at_s, string_agg(cluster, ',' ORDER BY q) AS heard FROM (SELECT conv_id, at_s, cluster, min(seq) AS q FROM c WHERE tier IS NOT NULL AND cluster IS NOT NULL GROUP BY ALL) GROUP BY ALL) h ON p.conv_id = h.conv_id AND p.at_s = h.at_s")
def voice_at_instant(spark, sf_dir):
    c = Tables(spark, sf_dir).conversations
    turns = c.select("conv_id", F.col("turn").alias("seq"), (F.col("turn") * 7.5).alias("start_s"), (F.col("turn") * 7.5 + 6).alias("end_s"), F.when(F.col("role") != "user", F.col("turn") % 3).alias("cluster"))
    probes = c.select("conv_id").distinct().withColumn("at_s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long"), F.lit(3).cast("long"))))
    return intervals.point_lookup(turns, probes, "conv_id").withColumn("heard", F.array_join("heard", ","))


_FR = "(SELECT user_id, value AS p, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::BIGINT AS i FROM events)"


def _frames(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window

    e = Tables(spark, sf_dir).events
    return e.select("user_id", F.col("value").alias("p"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("i"))


@query(f"WITH a AS (SELECT *, coalesce(last_value(CASE WHEN p > 60 THEN 1 WHEN p < 20 THEN 0 END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i), 0) AS o FROM {_FR}), l AS (SELECT *, CASE WHEN o <> coalesce(lag(o) OVER (PARTITION BY user_id ORDER BY i), 0) THEN 1 ELSE 0 END AS c FROM a), g AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY i) AS g FROM l), r AS (SELECT user_id, min(i) AS s, max(i) + 1 AS e FROM g WHERE o = 1 GROUP BY user_id, g), k AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY user_id ORDER BY s) <= 1 THEN 0 ELSE 1 END AS c FROM r), h AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY s) AS h FROM k) SELECT user_id, min(s) AS \"start\", max(e) AS \"end\" FROM h GROUP BY user_id, h HAVING max(e) - min(s) >= 3")
def hysteresis_turns(spark, sf_dir):
    return segments.hysteresis(_frames(spark, sf_dir), ["user_id"], "i", "p", 60, 20, 1, 3)


@query(f"WITH f AS {_FR}, z AS (SELECT user_id, max(i) + 1 AS n FROM f GROUP BY 1), a AS (SELECT *, sum(CASE WHEN p >= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY i) AS g FROM f), b AS (SELECT user_id, g, min(i) AS f1, min(i) FILTER (p < 35) AS o, coalesce(max(i) FILTER (p < 35) - min(i) FILTER (p < 35) >= 2, false) AS cl FROM a WHERE g > 0 GROUP BY ALL), c AS (SELECT *, CASE WHEN coalesce(lag(cl) OVER (PARTITION BY user_id ORDER BY g), true) THEN 1 ELSE 0 END AS x FROM b), d AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY g) AS h FROM c), e AS (SELECT d.user_id, n, min(f1) AS s, coalesce(max(o) FILTER (cl), n) AS e FROM d JOIN z USING (user_id) GROUP BY d.user_id, h, n), k AS (SELECT *, CASE WHEN s - lag(e) OVER (PARTITION BY user_id ORDER BY s) < 2 THEN 0 ELSE 1 END AS x FROM e WHERE e - s > 1), m AS (SELECT *, sum(x) OVER (PARTITION BY user_id ORDER BY s) AS q FROM k), q AS (SELECT user_id, n, min(s) AS s, max(e) AS e FROM m GROUP BY user_id, n, q HAVING max(e) - min(s) >= 1), w AS (SELECT *, s - lag(e) OVER v AS bf, lead(s) OVER v - e AS af FROM q WINDOW v AS (PARTITION BY user_id ORDER BY s)) SELECT user_id, greatest(s - CASE WHEN bf < 2 THEN bf // 2 ELSE 1 END, 0) AS \"start\", least(e + CASE WHEN af < 2 THEN af // 2 ELSE 1 END, n) AS \"end\" FROM w")
def speech_regions(spark, sf_dir):
    return segments.regions(_frames(spark, sf_dir), ["user_id"], "i", "p", 50, 35, 2, 1, 2, 1)


@query(f"SELECT user_id, i, round(avg(p) OVER (PARTITION BY user_id ORDER BY i ROWS 4 PRECEDING), 6) AS smoothed FROM {_FR}")
def smoothed_frames(spark, sf_dir):
    return segments.moving_average(_frames(spark, sf_dir), ["user_id"], "i", "p").select("user_id", "i", F.round("smoothed", 6).alias("smoothed"))


@query("WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY i) THEN 0 ELSE 1 END AS n FROM e), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY i) AS run FROM c) SELECT user_id, run::BIGINT AS run, min(event_type) AS event_type, arg_min(value, i) AS \"start\", arg_max(value, i) AS \"end\", string_agg(props, ' ' ORDER BY i) AS text, count(*) AS n FROM g GROUP BY user_id, run")
def speaker_blocks(spark, sf_dir):
    from pyspark.sql import Window

    e = Tables(spark, sf_dir).events.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    e = e.select("user_id", "i", "event_type", F.col("value").alias("v1"), F.col("value").alias("v2"), "props")
    return segments.blocks(e, ["user_id"], "i", "event_type", "v1", "v2", "props")


@query("WITH d AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1)::BIGINT - 1 AS i, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT *, coalesce(array_to_string(list_filter(list_transform(regexp_split_to_array(lower(line), '\\s+'), lambda w: array_to_string(regexp_extract_all(w, '[\\p{L}\\p{N}]+'), '')), lambda w: w <> ''), ' '), '') AS plain FROM d), c AS (SELECT *, CASE WHEN plain = lag(plain) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS n FROM p), g AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM c) SELECT doc_id, min(i) AS \"first\", max(i) AS \"last\", count(*) AS n, min(plain) AS plain FROM g GROUP BY doc_id, run HAVING (count(*) >= 3 AND len(string_split(min(plain), ' ')) >= 3) OR count(*) >= 5")
def repetition_loops(spark, sf_dir):
    lines = Tables(spark, sf_dir).documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).withColumn("i", F.col("i").cast("long"))
    return segments.loops(lines, ["doc_id"], "i", "line")


@query("WITH e AS (SELECT user_id, event_id, ts, value > 50 AS on_ FROM events), l AS (SELECT *, coalesce(lag(on_) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS was FROM e) SELECT user_id, event_id, CASE WHEN on_ THEN 'started' ELSE 'stopped' END AS edge FROM l WHERE on_ <> was")
def activity_edges(spark, sf_dir):
    e = Tables(spark, sf_dir).events.withColumn("o", F.struct("ts", "event_id"))
    return segments.edges(e, ["user_id"], "o", F.col("value") > 50).select("user_id", "event_id", "edge")


@query(f"WITH e AS (SELECT user_id, s, s + floor(value)::BIGINT * 60 AS e FROM {EVENTS}), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e), n AS (SELECT *, sum(CASE WHEN s - last < 10800 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS session FROM m) SELECT user_id, session::BIGINT AS session, min(s) AS \"start\", max(e) AS \"end\", count(*) AS n FROM n GROUP BY user_id, session")
def grace_sessions(spark, sf_dir):
    e = Tables(spark, sf_dir).events_s().select("user_id", "s", (F.col("s") + F.floor("value") * 60).cast("long").alias("e"))
    return segments.grace_sessions(e, ["user_id"], "s", "e", 10800)


_SPANS = "(SELECT conv_id, turn, turn * 8 AS s, turn * 8 + CASE WHEN turn % 3 = 0 THEN 11 ELSE 7 END AS e, 45 AS size FROM conversations)"


@query(f"WITH r AS {_SPANS}, p AS (SELECT *, lead(s) OVER (PARTITION BY conv_id ORDER BY s, e) AS n FROM r), q AS (SELECT *, least(CASE WHEN n IS NULL THEN e ELSE least(e + 2, n) END, size) AS pe FROM p), k AS (SELECT *, greatest(s, coalesce(max(pe) OVER (PARTITION BY conv_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s)) AS ps FROM q) SELECT conv_id, turn, ps::DOUBLE AS piece_start_s, pe::DOUBLE AS piece_end_s, coalesce(sum(pe - ps + 1) OVER (PARTITION BY conv_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS spliced_s FROM k WHERE pe > ps")
def splice_plan(spark, sf_dir):
    """Every third region runs into the next one, and the track ends at 45 s."""
    turn = F.col("turn")
    r = Tables(spark, sf_dir).conversations.select("conv_id", "turn", (turn * 8).cast("double").alias("start_s"), (turn * 8 + F.when(turn % 3 == 0, 11).otherwise(7)).cast("double").alias("end_s"), F.lit(45.0).alias("size"))
    return segments.splice(r, ["conv_id"], 2.0, 1.0, "size").select("conv_id", "turn", "piece_start_s", "piece_end_s", "spliced_s")


@query(f"WITH f AS {_FR}, l AS (SELECT * FROM f WHERE abs(p) > 60), g AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY user_id ORDER BY i) - 1 <= 1 THEN 0 ELSE 1 END AS c FROM l), h AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY i) AS g FROM g), m AS (SELECT user_id, max(n) AS longest FROM (SELECT user_id, max(i) - min(i) + 1 AS n FROM h GROUP BY user_id, g) GROUP BY 1) SELECT f.user_id, max(abs(p)) AS peak, count(*) FILTER (abs(p) > 60) AS audible, coalesce(max(longest), 0) AS longest FROM f LEFT JOIN m USING (user_id) GROUP BY f.user_id")
def level_summary(spark, sf_dir):
    return segments.levels(_frames(spark, sf_dir), ["user_id"], "i", "p", 60, 1)


@query(f"WITH f AS (SELECT user_id AS track, i, p + 0.001 AS e, i + 1 AS k FROM {_FR}), b AS (SELECT track, k, avg(e) OVER (PARTITION BY track ORDER BY k ROWS 3 PRECEDING) AS e FROM f), a AS (SELECT * FROM b WHERE k >= 4 AND -0.691 + 10 * log10(e) > -70), g AS (SELECT track, -0.691 + 10 * log10(avg(e)) - 10 AS gate FROM a GROUP BY 1) SELECT track, round(-0.691 + 10 * log10(avg(e)), 6) AS lufs, count(*) AS n_blocks FROM a JOIN g USING (track) WHERE -0.691 + 10 * log10(e) > gate GROUP BY track")
def integrated_loudness(spark, sf_dir):
    f = _frames(spark, sf_dir).select(F.col("user_id").alias("track"), (F.col("i") + 1).alias("k"), (F.col("p") + 0.001).alias("e"))
    return stats.gated_loudness(f, ["track"], "k", "e").withColumn("lufs", F.round("lufs", 6))


@query("WITH t AS (SELECT conv_id, turn, role, turn * 7.5 AS s, turn * 7.5 + 5.0004 AS e, text FROM conversations) SELECT conv_id, turn, printf('%02d:%02d', (floor(s)::BIGINT // 60), floor(s)::BIGINT % 60) AS label, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS cue_start, printf('%02d:%02d:%02d.%03d', me // 3600000, me // 60000 % 60, me // 1000 % 60, me % 1000) AS cue_end, regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '[\\r\\n]+', ' ', 'g') AS cue FROM (SELECT *, round(s * 1000)::BIGINT AS ms, greatest(round(e * 1000), round(s * 1000) + 1)::BIGINT AS me FROM t)")
def transcript_cues(spark, sf_dir):
    s = (F.col("turn") * 7.5).cast("double")
    return Tables(spark, sf_dir).conversations.select("conv_id", "turn", T.mmss(s).alias("label"), T.vtt_time(s).alias("cue_start"), T.vtt_end(s, s + 5.0004).alias("cue_end"), T.cue_text(F.col("text")).alias("cue"))


@query("WITH n AS (SELECT DISTINCT lower(p_name) AS name FROM part), q AS (SELECT DISTINCT split_part(name, ' ', 1) AS typed FROM n UNION SELECT name FROM n) SELECT typed, name, CASE WHEN typed = name THEN 'same' WHEN starts_with(name, typed) THEN 'prefix' ELSE 'word_prefix' END AS likeness FROM q, n WHERE typed = name OR starts_with(name, typed) OR len(list_filter(string_split(name, ' '), lambda w: starts_with(w, typed))) > 0")
def name_likeness(spark, sf_dir):
    n = Tables(spark, sf_dir).part.select(F.lower("p_name").alias("name")).distinct()
    q = n.select(F.split_part("name", F.lit(" "), F.lit(1)).alias("typed")).union(n.select("name")).distinct()
    found = names.name_matches(q, n).filter("rank < 3")
    return found.select("typed", "name", F.when(F.col("rank") == 0, "same").when(F.col("rank") == 1, "prefix").otherwise("word_prefix").alias("likeness"))


_TYPED = "(SELECT n_nationkey AS k, CASE n_nationkey % 5 WHEN 0 THEN substr(n, 2, 1) || substr(n, 1, 1) || substr(n, 3) WHEN 1 THEN substr(n, 1, 2) || substr(n, 4) WHEN 2 THEN substr(n, 1, length(n) - 1) || 'q' WHEN 3 THEN substr(n, 1, 2) || 'z' || substr(n, 4, 1) || substr(n, 3, 1) || substr(n, 5) ELSE n END AS typed FROM (SELECT n_nationkey, lower(n_name) AS n FROM nation))"


@query(f"WITH n AS (SELECT DISTINCT lower(n_name) AS name FROM nation), q AS (SELECT DISTINCT typed FROM {_TYPED}) SELECT typed, name, CASE WHEN typed = name THEN 0 WHEN starts_with(name, typed) THEN 1 WHEN len(list_filter(string_split(name, ' '), lambda w: starts_with(w, typed))) > 0 THEN 2 ELSE 3 END::INT AS rank FROM q, n WHERE typed = name OR starts_with(name, typed) OR len(list_filter(string_split(name, ' '), lambda w: starts_with(w, typed))) > 0 OR damerau_levenshtein(typed, name) <= CASE WHEN length(typed) < 4 THEN 0 WHEN length(typed) < 8 THEN 1 ELSE 2 END")
def near_names(spark, sf_dir):
    """Names with two letters changed about, one left out, one replaced, or two of these."""
    n, k = F.lower("n_name"), F.col("n_nationkey") % 5
    part = lambda i, m=None: F.substr(n, F.lit(i), F.lit(m)) if m else F.substr(n, F.lit(i))
    typed = F.when(k == 0, F.concat(part(2, 1), part(1, 1), part(3))).when(k == 1, F.concat(part(1, 2), part(4))).when(k == 2, F.concat(F.substr(n, F.lit(1), F.char_length(n) - 1), F.lit("q"))).when(k == 3, F.concat(part(1, 2), F.lit("z"), part(4, 1), part(3, 1), part(5))).otherwise(n)
    t = Tables(spark, sf_dir).nation
    return names.name_matches(t.select(typed.alias("typed")), t.select(n.alias("name")))


@query(f"WITH s AS (SELECT c.session, c.id, r.name, list_inner_product(c.embedding::DOUBLE[], r.rv::DOUBLE[]) AS sim FROM {_CL} c, {_REF} r), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, name) AS n FROM s), k AS (SELECT * FROM b WHERE n = 1 AND 1 - sim < {CUT}), x AS (SELECT a.session, a.id FROM k a JOIN {_BOTH} e ON a.id = e.a JOIN k o ON o.id = e.b AND o.name = a.name AND (o.sim > a.sim OR (o.sim = a.sim AND o.id < a.id))) SELECT k.session, k.id, k.name, round(k.sim, 6) AS similarity FROM k LEFT JOIN x ON k.id = x.id WHERE x.id IS NULL")
def awarded_names(spark, sf_dir):
    return _awarded(Tables(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


def _claims(t: Tables) -> DataFrame:
    c = t.clusters()
    return vec.nearest_name(c, t.references(), CUT, "id").join(c.select("id", "session"), "id").select("session", "id", "name", "similarity")


def _awarded(t: Tables) -> DataFrame:
    return assign.award_names(_claims(t), t.conflicts(), ["session"])


def _tentative(t: Tables) -> DataFrame:
    c = t.clusters()
    ranked = vec.ranked_names(c.filter("speech_s < 5"), t.references(), "id").join(c.select("id", "session"), "id").select("session", "id", "name", "similarity")
    return assign.tentative_names(ranked, _awarded(t), t.conflicts(), ["session"], LOOSE)


@query()
def tentative_names(spark, sf_dir):
    return _tentative(Tables(spark, sf_dir)).withColumn("similarity", F.round("similarity", 6))


def _ranked(t: Tables, under: float | None = None) -> DataFrame:
    """Every cluster beside every reference, or beside those at a distance under `under`."""
    refs = t.references().select("name", F.col("vec_id").alias("reference"), "embedding")
    return vec.compared(t.clusters().select("session", "id", "embedding"), refs, under=under)


def _near(t: Tables) -> DataFrame:
    """Each name's best similarity for each cluster, where it is near enough to count for a label."""
    return checkpointed(_ranked(t, max(CUT, LOOSE)).groupBy("session", "id", "name").agg(F.max("similarity").alias("similarity")))


def _labels(t: Tables, derive=assign.derived_labels, **change: str) -> DataFrame:  # noqa: ANN001
    c = t.clusters()
    hand = c.filter("id % 37 = 0").select("session", "id", F.lit("Hand").alias("name"))
    denied = c.filter("id % 11 = 0").select("session", "id", F.concat(F.lit("spk"), F.col("label")).alias("name"))
    forced = c.filter("id % 59 = 0").select("session", "id", F.lit("Forced").alias("name"))
    return derive(c, _near(t), hand, denied, forced, t.conflicts(), ["session"], CUT, LOOSE, **change)


@query()
def effective_labels(spark, sf_dir):
    return _labels(Tables(spark, sf_dir))


@query()
def labels_without_a_name(spark, sf_dir):
    """What changes if every reference of one name went."""
    return _labels(Tables(spark, sf_dir), assign.label_changes, without="spk3")


@query()
def linkage_groups(spark, sf_dir):
    from pyspark.sql import Window

    t = Tables(spark, sf_dir)
    c = t.clusters().filter("speech_s < 6").withColumn("pos", F.row_number().over(Window.partitionBy("session").orderBy("first_s", "id")))
    o = c.select("session", F.col("pos").alias("j"), F.col("embedding").alias("e2"))
    pairs = c.select("session", F.col("pos").alias("i"), "embedding").join(o, "session").filter("i < j").select("session", "i", "j", V.cosine_distance(F.col("embedding"), F.col("e2")).alias("distance"))
    return assign.linkage_groups(c.select("session", "pos", "id"), pairs, t.conflicts(), ["session"], 0.8)


@query("SELECT user_id AS k, round(list_sort(list(value))[(count(*) // 2 + 1)::INT], 6) AS upper FROM events GROUP BY 1")
def upper_medians(spark, sf_dir):
    e = Tables(spark, sf_dir).events.select(F.col("user_id").alias("k"), "value")
    return stats.upper_medians(e, ["k"], "value").withColumn("upper", F.round("upper", 6))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf_dir):
    t = Tables(spark, sf_dir).lineitem.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def local_supplier_volume(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.supplier, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


from tideline.plans import answers, meetings, naming, previews, sessions, streams  # noqa: E402, F401  (register their queries)
