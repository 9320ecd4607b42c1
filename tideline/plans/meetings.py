"""Queries over meetings, processes, samples and texts, with their SQL. Registered with the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.operators import intervals, meetings, names, planning, segments, signal, stats
from tideline.plans.catalog import _FR, EVENTS, Tables, _frames, query
from tideline.streaming import recording


def _calendar(t: Tables) -> DataFrame:
    """Events as calendar entries: views last all day, errors were cancelled, and the user declined every third one."""
    e = t.events_s()
    attendees = F.array(F.struct((F.col("event_id") % 3 == 0).alias("is_you"), F.lit("declined").alias("status")))
    return e.select("user_id", "event_id", F.col("s").alias("start_s"), (F.col("s") + F.floor("value") * 60).cast("long").alias("end_s"), (F.col("event_type") == "view").alias("all_day"), (F.col("event_type") == "error").alias("cancelled"), attendees.alias("attendees"))


@query(f"SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS place FROM {EVENTS} WHERE event_type NOT IN ('view', 'error') AND event_id % 3 <> 0")
def offered_meetings(spark, sf_dir):
    return meetings.offered(_calendar(Tables(spark, sf_dir)), ["user_id"]).select("user_id", "event_id", "place")


@query(f"WITH m AS (SELECT user_id, min(s) + 864000 AS at_s FROM {EVENTS} GROUP BY user_id) SELECT e.user_id, e.event_id FROM {EVENTS} e JOIN m ON e.user_id = m.user_id AND s < at_s + 86400 AND s + floor(value) * 60 > at_s - 86400")
def around_instants(spark, sf_dir):
    """Entries within a day of the instant ten days after a user's first one."""
    c = _calendar(Tables(spark, sf_dir))
    at = c.groupBy(F.col("user_id").alias("_u")).agg((F.min("start_s") + 864000).alias("at_s"))
    return intervals.candidates_around(c.join(at, F.col("user_id") == F.col("_u")), F.col("at_s"), 86400).select("user_id", "event_id")


_PROCESS = "(SELECT c_custkey, c_nationkey, nullif(c_custkey % 10, 3) AS pid, nullif(c_mktsegment, 'BUILDING') AS bundle, '/bin/' || nullif(c_nationkey, 5) AS exe, c_acctbal > 0 AS running FROM customer)"
_BEARING = f"(SELECT *, CASE WHEN pid IS NULL THEN 'pid_unknown' WHEN pid = 0 THEN 'own' WHEN bundle = 'FURNITURE' THEN 'helper' WHEN bundle = 'MACHINERY' THEN 'bundle' WHEN exe = '/bin/9' THEN 'own_executable' WHEN exe IN ('/bin/7', '/bin/8') THEN 'executable' ELSE 'activity' END AS bearing FROM {_PROCESS})"


def _processes(t: Tables) -> DataFrame:
    listed = lambda *v: t.spark.createDataFrame([(x,) for x in v], "value string")
    c = t.customer.select("c_custkey", "c_nationkey", F.nullif(F.col("c_custkey") % 10, F.lit(3)).alias("pid"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("bundle_id"), F.concat(F.lit("/bin/"), F.nullif("c_nationkey", F.lit(5))).alias("executable"), (F.col("c_acctbal") > 0).alias("running"))
    known = meetings.excluded(c, listed("MACHINERY", "MACHINERY", None), listed("/bin/7", "/bin/8"))
    return meetings.bearing(known, F.lit(0), F.lit("/bin/9"), ["FURNITURE"])


@query(f"SELECT c_custkey, bearing FROM {_BEARING}")
def process_bearings(spark, sf_dir):
    return _processes(Tables(spark, sf_dir)).select("c_custkey", "bearing")


@query(f"SELECT c_nationkey, bool_or(running AND bearing = 'activity') AS capturing FROM {_BEARING} GROUP BY c_nationkey")
def someone_captures(spark, sf_dir):
    return meetings.someone_captures(_processes(Tables(spark, sf_dir)), ["c_nationkey"])


_MEETING = "(SELECT c_custkey, c_nationkey::BIGINT AS event_id, CASE c_custkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'started' WHEN 2 THEN 'joined_late' END AS fit, c_custkey % 7 = 0 AS cleared, c_mktsegment AS attendee, c_custkey % 2 = 0 AS transcribed FROM customer)"


def _labelled(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    fit = F.when(k % 4 == 0, "confirmed").when(k % 4 == 1, "started").when(k % 4 == 2, "joined_late")
    return t.customer.select("c_custkey", F.col("c_nationkey").cast("long").alias("event_id"), fit.alias("fit"), (k % 7 == 0).alias("cleared"), F.array("c_mktsegment").alias("attendees"), (k % 2 == 0).alias("transcribed"))


@query(f"SELECT c_custkey, CASE WHEN fit IN ('confirmed', 'started') THEN attendee END AS speakers FROM {_MEETING}")
def speaker_rosters(spark, sf_dir):
    return meetings.roster(_labelled(Tables(spark, sf_dir))).select("c_custkey", F.array_join("speakers", ",").alias("speakers"))


@query(f"SELECT c_custkey, CASE WHEN cleared OR coalesce(fit, '') = 'confirmed' THEN event_id WHEN c_custkey % 5 <> 0 THEN event_id + 100 END AS event_id, CASE WHEN cleared OR coalesce(fit, '') = 'confirmed' THEN fit WHEN c_custkey % 5 <> 0 THEN 'started' END AS fit FROM {_MEETING}")
def automatic_labels(spark, sf_dir):
    s = _labelled(Tables(spark, sf_dir))
    found = s.filter("c_custkey % 5 <> 0").select("c_custkey", (F.col("event_id") + 100).alias("event_id"), F.lit("started").alias("fit"))
    return meetings.automatic_labels(s, found, "c_custkey").select("c_custkey", "event_id", "fit")


@query(f"WITH c AS (SELECT *, c_custkey % 3 = 0 AS asked, nullif(c_custkey % 4, 3) AS place FROM {_MEETING}), s AS (SELECT *, CASE WHEN NOT asked THEN 'unchanged' WHEN place IS NULL THEN 'cleared' WHEN place > 1 THEN 'not_offered' ELSE 'labelled' END AS status FROM c) SELECT c_custkey, status, CASE status WHEN 'labelled' THEN 1000 + place WHEN 'cleared' THEN NULL ELSE event_id END AS event_id, CASE status WHEN 'labelled' THEN 'confirmed' WHEN 'cleared' THEN NULL ELSE fit END AS fit, CASE status WHEN 'labelled' THEN false WHEN 'cleared' THEN true ELSE cleared END AS cleared, status IN ('labelled', 'cleared') AND transcribed AS render FROM s")
def manual_labels(spark, sf_dir):
    s = _labelled(Tables(spark, sf_dir))
    choices = s.filter("c_custkey % 3 = 0").select("c_custkey", F.nullif(F.col("c_custkey") % 4, F.lit(3)).alias("place"))
    offers = s.select("c_custkey", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("place")).withColumn("event_id", F.col("place") + 1000)
    return meetings.labelled_by_hand(s, choices, offers, "c_custkey").select("c_custkey", "status", "event_id", "fit", "cleared", "render")


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'edited' ELSE attendee END AS attendees FROM {_MEETING}")
def roster_edits(spark, sf_dir):
    """Edits of every other session, half of which are of an event that it no longer has."""
    s = _labelled(Tables(spark, sf_dir))
    edits = s.filter("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.col("event_id")).otherwise(-1).alias("event_id"), F.array(F.lit("edited")).alias("attendees"))
    return meetings.roster_edits(s, edits, "c_custkey").select("c_custkey", F.array_join("attendees", ",").alias("attendees"))


@query("SELECT kind, string_agg(DISTINCT value, ',' ORDER BY value) AS \"values\" FROM (SELECT 'a' AS kind, c_mktsegment AS value FROM customer UNION ALL SELECT 'b', p_brand FROM part UNION ALL SELECT 'a', o_orderpriority FROM orders) GROUP BY kind")
def app_identities(spark, sf_dir):
    t = Tables(spark, sf_dir)
    kind = lambda df, k, c: df.select(F.lit(k).alias("kind"), F.col(c).alias("value"))
    return meetings.identities(kind(t.customer, "a", "c_mktsegment"), kind(t.part, "b", "p_brand"), kind(t.orders, "a", "o_orderpriority")).withColumn("values", F.array_join("values", ","))


@query("SELECT o_custkey AS session FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def changed_sessions(spark, sf_dir):
    return meetings.changed_sessions(Tables(spark, sf_dir).orders.filter("o_orderstatus = 'F'"), "o_custkey").withColumnRenamed("o_custkey", "session")


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) AS n FROM orders GROUP BY o_orderpriority")
def batch_counters(spark, sf_dir):
    return meetings.counters(Tables(spark, sf_dir).orders, ["o_orderpriority"], "o_orderstatus", ["F", "O"])


@query("SELECT conv_id, turn, trim(text) AS text FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN '  ' || text || ' ' WHEN 1 THEN ' [BLANK_AUDIO] ' WHEN 2 THEN '   ' ELSE text END AS text FROM conversations) WHERE trim(text) NOT IN ('', '[BLANK_AUDIO]')")
def spoken_segments(spark, sf_dir):
    k = F.col("turn") % 4
    c = Tables(spark, sf_dir).conversations.select("conv_id", "turn", F.when(k == 0, F.concat(F.lit("  "), "text", F.lit(" "))).when(k == 1, " [BLANK_AUDIO] ").when(k == 2, "   ").otherwise(F.col("text")).alias("text"))
    return meetings.spoken(c, "text")


@query("SELECT 'spk' || label AS name, min(vec_id) AS first FROM embeddings GROUP BY label")
def enrolled_names(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings.select(F.concat(F.lit("spk"), "label").alias("name"), "vec_id")
    return names.names_by_appearance(e, "vec_id")


@query("WITH n AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS handle FROM embeddings WHERE label <> 4) SELECT vec_id, label AS name FROM n WHERE handle <> label + 1")
def references_without(spark, sf_dir):
    """Without all of name 4, and without the reference of each other name whose number is one more than the name."""
    e = Tables(spark, sf_dir).embeddings.select(F.col("label").alias("name"), "vec_id")
    kept = names.without_person(e, spark.createDataFrame([(4,)], "name int"))
    return names.without_reference(kept, kept.select("name", (F.col("name") + 1).alias("handle")).distinct(), "vec_id").select("vec_id", "name")


# --- samples


@query(f"WITH s AS (SELECT user_id, i, p AS plain, CASE WHEN i % 11 <> 3 THEN -p END AS isolated FROM {_FR}), k AS (SELECT *, i // 20 * 20 + 2 AS a, i // 20 * 20 + 17 AS b, i // 20 % 2 = 0 AS fi, i // 20 % 3 = 0 AS fo FROM s) SELECT user_id, i, round(CASE WHEN isolated IS NULL OR i < a OR i >= b THEN plain ELSE plain + least(CASE WHEN fi THEN (i - a) / 6.0::DOUBLE ELSE 1 END, CASE WHEN fo THEN (b - i) / 6.0::DOUBLE ELSE 1 END, 1) * (isolated - plain) END, 6) AS value FROM k")
def faded_samples(spark, sf_dir):
    f = _frames(spark, sf_dir)
    s = f.select("user_id", "i", F.col("p").alias("plain"), F.when(F.col("i") % 11 != 3, -F.col("p")).alias("isolated"))
    n = F.floor(F.col("i") / 20)
    pieces = f.select("user_id", n.alias("n")).distinct().select("user_id", (F.col("n") * 20 + 2).alias("piece_start"), (F.col("n") * 20 + 17).alias("piece_end"), (F.col("n") % 2 == 0).alias("fade_in"), (F.col("n") % 3 == 0).alias("fade_out"))
    return signal.faded(s, pieces, ["user_id"], 6).withColumn("value", F.round("value", 6))


@query(f"WITH t AS (SELECT user_id, arg_max(i, (round(p), i)) AS i, max(round(p)) AS v, max(i) AS z FROM {_FR} GROUP BY 1), r AS (SELECT t.*, sqrt(avg(round(p) * round(p))) AS r FROM t JOIN {_FR} f ON f.user_id = t.user_id AND abs(f.i - t.i) > 3 GROUP BY ALL) SELECT user_id, i AS peak_at FROM r WHERE v > 0 AND i >= 2 AND i <= z - 2 AND r > 0 AND v / r >= 2.5")
def correlation_peaks(spark, sf_dir):
    f = _frames(spark, sf_dir).withColumn("v", F.round("p"))
    return signal.correlation_peaks(f, ["user_id"], "i", "v", 2, 3, 2.5)


@query(f"SELECT user_id, round(list_sort(list(l))[(count(*) // 2 + 1)::INT], 6) AS floor FROM (SELECT user_id, i // 5 AS b, sqrt(avg(p * p)) AS l FROM {_FR} GROUP BY ALL) GROUP BY user_id")
def noise_floors(spark, sf_dir):
    return signal.noise_floor(_frames(spark, sf_dir), ["user_id"], "i", "p", 5).withColumn("floor", F.round("floor", 6))


@query(f"SELECT user_id, list_sort(list(p))[(count(*) // 2 + 1)::INT] AS median FROM {_FR} WHERE i % 10 = 0 GROUP BY user_id")
def sampled_medians(spark, sf_dir):
    return signal.sampled_median(_frames(spark, sf_dir), ["user_id"], "i", "p", 10)


@query(f"SELECT user_id, i AS \"start\", round(e, 4) AS energy FROM (SELECT user_id, i, sum(p * p) OVER w AS e, count(*) OVER w AS n FROM {_FR} WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) WHERE n = 8")
def window_energies(spark, sf_dir):
    return signal.energies(_frames(spark, sf_dir), ["user_id"], "i", "p", 8, 1).withColumn("energy", F.round("energy", 4))


def greedy(candidates: str, apart: int, most: int) -> str:
    """SQL that walks each user's candidates (user_id, start, energy) by falling energy and takes what is far from all taken."""
    return (
        f"WITH RECURSIVE c AS (SELECT user_id, start, row_number() OVER (PARTITION BY user_id ORDER BY energy DESC, start) AS n FROM ({candidates}) WHERE energy > 0),"
        f" w AS (SELECT user_id, 0::BIGINT AS n, []::BIGINT[] AS taken FROM (SELECT DISTINCT user_id FROM c)"
        f" UNION ALL SELECT w.user_id, c.n, CASE WHEN len(taken) < {most} AND len(list_filter(taken, lambda t: abs(t - c.start) < {apart})) = 0 THEN list_append(taken, c.start) ELSE taken END FROM w JOIN c ON c.user_id = w.user_id AND c.n = w.n + 1)"
        f" SELECT user_id, unnest(arg_max(taken, n)) AS start FROM w GROUP BY user_id"
    )


@query(greedy(f"SELECT user_id, k * 2 AS start, round(sum(p * p), 6) AS energy FROM {_FR} JOIN range(0, 100000) r(k) ON i >= k * 2 AND i < k * 2 + 8 GROUP BY user_id, k HAVING count(*) = 8", 8, 4))
def loudest_stretches(spark, sf_dir):
    """The loudest windows by their measured energy, which start every quarter of a window."""
    e = signal.energies(_frames(spark, sf_dir), ["user_id"], "i", "p", 8)
    return planning.loud_windows(e.withColumn("energy", F.round("energy", 6)), ["user_id"], 8, 4)


@query(f"WITH l AS (SELECT user_id % 2 AS source, user_id // 2 AS pair, i, p / 100 AS v FROM {_FR}), s AS (SELECT pair, source, -20 - source * 3 - max(v) AS lufs, CASE source WHEN 0 THEN -0.5 ELSE 0.75 END::DOUBLE AS pan, source * 1.5::DOUBLE AS off FROM l GROUP BY pair, source), g AS (SELECT *, pow(10, least(-23 - lufs, 6) / 20) AS gain, (greatest(-1, least(1, pan)) + 1) * pi() / 4 AS th FROM s), m AS (SELECT l.pair, l.i + floor(off * 4 + 0.5)::BIGINT AS i, sum(v * gain * cos(th)) AS l, sum(v * gain * sin(th)) AS r FROM l JOIN g USING (pair, source) GROUP BY ALL), k AS (SELECT pair, max(greatest(abs(l), abs(r))) AS peak FROM m GROUP BY 1) SELECT pair, i, round(l * CASE WHEN peak > 0.99 THEN 0.99 / peak ELSE 1 END, 6) AS \"left\", round(r * CASE WHEN peak > 0.99 THEN 0.99 / peak ELSE 1 END, 6) AS \"right\" FROM m JOIN k USING (pair)")
def mixed_tracks(spark, sf_dir):
    """Two users are the two sources of a mix, levelled by their (stand-in) loudness."""
    f = _frames(spark, sf_dir).select(F.floor(F.col("user_id") / 2).alias("pair"), (F.col("user_id") % 2).alias("source"), "i", (F.col("p") / 100).alias("value"))
    lufs = -20 - F.col("source") * 3 - F.max("value")
    s = f.groupBy("pair", "source").agg(lufs.alias("lufs")).select("pair", "source", (F.col("source") * 1.5).cast("double").alias("offset_s"), signal.gain(F.col("lufs"), -23.0, 6.0).alias("gain"), F.when(F.col("source") == 0, -0.5).otherwise(0.75).alias("pan"))
    return signal.mixed_down(f, s, ["pair"], 4).select("pair", "i", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"))


@query(f"SELECT user_id, round(20 * log10(max(abs(p)) / 1000), 6) AS peak_dbfs FROM {_FR} GROUP BY user_id")
def peak_levels(spark, sf_dir):
    return _frames(spark, sf_dir).groupBy("user_id").agg(F.round(signal.dbfs(F.max(F.abs("p")) / 1000), 6).alias("peak_dbfs"))


@query("WITH r AS (SELECT conv_id, turn, CASE WHEN turn < 4 THEN 'one two, THREE' ELSE text END AS text, turn * 5 AS s, turn * 5 + 4 AS e FROM conversations), n AS (SELECT *, lower(regexp_replace(text, '[^a-zA-Z ]', '', 'g')) AS p FROM r), h AS (SELECT conv_id, count(*) FILTER (turn < 4) AS k FROM r GROUP BY 1), x AS (SELECT n.*, turn < 4 AND k >= 3 AS looped FROM n JOIN h USING (conv_id)) SELECT conv_id, min(turn) AS turn, arg_min(text, turn) AS text, min(s) AS s, max(e) AS e, count(*) AS n FROM x GROUP BY conv_id, CASE WHEN looped THEN -1 ELSE turn END")
def collapsed_loops(spark, sf_dir):
    """The first four turns of each conversation say the same."""
    c = Tables(spark, sf_dir).conversations.select("conv_id", "turn", F.when(F.col("turn") < 4, "one two, THREE").otherwise(F.col("text")).alias("text"), (F.col("turn") * 5).alias("s"), (F.col("turn") * 5 + 4).alias("e"))
    return segments.collapsed_loops(c, ["conv_id"], "turn", "s", "e", "text").withColumnRenamed("repeats", "n")


_LABEL = "printf('%d:%02d', (x // 60) % 100, x % 60)"


@query(f"WITH o AS (SELECT o_orderkey AS k, o_orderkey % 90000 AS x, floor(o_totalprice)::BIGINT AS y, o_orderpriority AS p FROM orders) SELECT k, x // 60 % 100 * 60 + x % 60 AS parsed, CASE WHEN x < 60 THEN printf('%ds', x) ELSE printf('%dm %02ds', x // 60, x % 60) END AS duration, CASE WHEN y < 60000 THEN printf('%d.%d s', y // 1000, y // 100 % 10) ELSE printf('%d:%02d:%02d', y // 3600000, y // 60000 % 60, y // 1000 % 60) END AS span, round(y * 125 / 3 / 1e6::DOUBLE, 6) AS millis, CASE WHEN x % 5 = 0 THEN 0 ELSE least(y * 100 // (x % 5 * 100000), 100) END AS percent, CASE WHEN x >= 60 THEN printf('%dm%02ds', x // 60, x % 60) ELSE printf('%ds', x) END AS elapsed, floor(x / 7.0::DOUBLE * 16 + 0.5)::BIGINT AS rounded, floor(x / 7.0::DOUBLE * 16)::BIGINT AS cut, '\"' || p || '\\\"\\\\' || '\"' AS yaml, CASE WHEN k % 2 = 0 THEN p || '@x' END AS mail FROM o")
def text_labels(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 90000).alias("x"), F.floor("o_totalprice").alias("y"), F.col("o_orderpriority").alias("p"))
    label = F.format_string("[%d:%02d]", F.floor(F.col("x") / 60) % 100, F.col("x") % 60)
    link = F.when(F.col("k") % 2 == 0, F.concat(F.lit("MailTo:"), "p", F.lit("@x"))).otherwise(F.concat(F.lit("http:"), "p"))
    return o.select(
        "k", T.parse_mmss(label).alias("parsed"), T.human_duration(F.col("x")).alias("duration"), T.audio_span(F.col("y")).alias("span"), F.round(T.ticks_to_millis(F.col("y"), F.lit(125), F.lit(3)), 6).alias("millis"),
        T.percent(F.col("y"), F.col("x") % 5 * 100000).alias("percent"), T.elapsed(F.col("x")).alias("elapsed"), T.sample_at(F.col("x") / 7, 16).alias("rounded"), T.sample_at(F.col("x") / 7, 16, False).alias("cut"),
        T.yaml_scalar(F.concat("p", F.lit('"\\'))).alias("yaml"), T.mail_address(link).alias("mail"),
    )


@query(f"WITH f AS (SELECT user_id, i, row_number() OVER (PARTITION BY user_id ORDER BY i >= 20, i) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM {_FR} WHERE i < 30) SELECT user_id, i, n > 15 AND k <= greatest(12, n - 15) AS leaves FROM f")
def queue_updates(spark, sf_dir):
    """The first 20 frames are the queue, ten more the chunk."""
    f = _frames(spark, sf_dir).filter("i < 30").select("user_id", "i")
    stays, leaves = recording.queue_update(f.filter("i < 20"), f.filter("i >= 20"), ["user_id"], "i", 15, 12)
    return stays.withColumn("leaves", F.lit(False)).unionByName(leaves.withColumn("leaves", F.lit(True)))
