"""Joins over time: overlap, nearest interval, as-of tiers and point lookup.

Intervals meet in time buckets: each goes to the buckets it touches, and the join is on keys and bucket, so that a session's
pairs are only those near each other. `width` is the bucket's length in the unit of the times; about the length of a usual
interval is right. Rows with a null time or key take part in no pair; empty tables give empty results.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def buckets(start: Column, end: Column, width: float) -> Column:
    """The numbers of the buckets that [start, end] touches; none for an interval that ends before it starts."""
    first, last = F.floor(start / width).cast("long"), F.floor(end / width).cast("long")
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _renamed(keys: list[str], mark: str) -> list[Column]:
    return [F.col(k).alias(f"{mark}{k}") for k in keys]


def _equal(keys: list[str], mark: str) -> list[Column]:
    return [F.col(k) == F.col(f"{mark}{k}") for k in keys]


def overlap_attribution(segments: DataFrame, turns: DataFrame, keys: list[str], segment: str = "seq", width: float = 600) -> DataFrame:
    """The cluster that speaks in each segment. segments: keys, segment, start_s, end_s; turns: keys, cluster, start_s, end_s.

    The cluster with the largest sum of overlaps wins (ties: smaller cluster); intervals that touch do not overlap. A
    segment without overlap gets the cluster with the smallest gap (ties: smaller cluster); without turns, null. Adds
    cluster, overlap_s and gap_s. Repeated turns add up; segments that repeat a segment number share a result.

    Overlaps are summed bucket by bucket. Only segments that touch no turn look for the nearest one, in a window over the
    ends before them and one over the starts after them.
    """
    t = turns.select(*_renamed(keys, "_"), "cluster", F.col("start_s").alias("_s"), F.col("end_s").alias("_e"))
    there = t.withColumn("_b", F.explode(buckets(F.col("_s"), F.col("_e"), width)))
    here = segments.select(*keys, segment, "start_s", "end_s").distinct().withColumn("b", F.explode(buckets(F.col("start_s"), F.col("end_s"), width)))
    met = here.join(there, [*_equal(keys, "_"), F.col("b") == F.col("_b"), F.col("_s") <= F.col("end_s"), F.col("start_s") <= F.col("_e")])
    both = F.least("end_s", "_e", (F.col("b") + 1) * width) - F.greatest("start_s", "_s", F.col("b") * width)
    by_cluster = met.groupBy(*keys, segment, "cluster").agg(F.sum(F.greatest(both, F.lit(0))).alias("o"))
    touching = by_cluster.groupBy(*keys, segment).agg(F.min(F.struct((-F.col("o")).alias("no"), F.col("cluster"))).alias("_t"))
    touching = touching.select(*keys, segment, F.col("_t.cluster").alias("cluster"), (-F.col("_t.no")).alias("overlap_s"), F.lit(0.0).alias("gap_s"))

    alone = segments.select(*keys, segment, "start_s", "end_s").filter("start_s IS NOT NULL AND end_s IS NOT NULL").distinct().join(touching, [*keys, segment], "left_anti")
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    found = []
    for mine, theirs, sign in (("start_s", "end_s", 1), ("end_s", "start_s", -1)):
        line = alone.select(*keys, segment, (sign * F.col(mine)).alias("at"), F.lit(1).alias("is_segment"), none("cluster", turns))
        line = line.unionByName(turns.select(*keys, none(segment, segments), (sign * F.col(theirs)).alias("at"), F.lit(0).alias("is_segment"), "cluster").filter("at IS NOT NULL"))
        w = Window.partitionBy(*keys).orderBy("at", "is_segment", F.desc("cluster"))
        last = F.last(F.when(F.col("is_segment") == 0, F.struct("at", "cluster")), ignorenulls=True).over(w)
        found.append(line.withColumn("_l", last).filter("is_segment = 1 AND _l IS NOT NULL").select(*keys, segment, (F.col("at") - F.col("_l.at")).alias("gap_s"), F.col("_l.cluster").alias("cluster")))
    nearest = found[0].unionByName(found[1]).groupBy(*keys, segment).agg(F.min(F.struct("gap_s", "cluster")).alias("_n"))
    nearest = nearest.select(*keys, segment, F.col("_n.cluster").alias("cluster"), F.lit(0.0).alias("overlap_s"), F.col("_n.gap_s").cast("double").alias("gap_s"))
    best = touching.select(*nearest.columns).unionByName(nearest).select(*_renamed(keys, "_"), F.col(segment).alias("_seg"), "cluster", "overlap_s", "gap_s")
    return segments.join(best, [*_equal(keys, "_"), F.col(segment) == F.col("_seg")], "left").drop("_seg", *[f"_{k}" for k in keys])


def asof_tiers(probes: DataFrame, events: DataFrame, keys: list[str], probe: str, near: int) -> DataFrame:
    """The event that fits each probe best. probes: keys, probe, at_s; events: keys, event_id, start_s, end_s (whole seconds).

    First an event that holds the instant (start included, end excluded), the shortest; then one that starts within `near`
    seconds, the earliest; then one that ended within `near` seconds, the latest. Ties: earlier start, smaller id. A probe
    meets the events within `near` seconds, in buckets of that width.
    """
    e = events.select(*_renamed(keys, "_"), "event_id", "start_s", "end_s")
    e = e.withColumn("_b", F.explode(buckets(F.col("start_s") - near, F.col("end_s") + near, near)))
    start, end, now = F.col("start_s"), F.col("end_s"), F.col("at_s")
    tier = F.when((start <= now) & (now < end), 1).when((start > now) & (start - now <= near), 2).when((end <= now) & (now - end <= near), 3)
    rank = F.when(F.col("tier") == 1, end - start).when(F.col("tier") == 2, start).otherwise(-end)
    fit = F.when((F.col("tier") == 1) & (now - start <= near), "started").when(F.col("tier") == 1, "joined_late").when(F.col("tier") == 2, "started_early").otherwise("after_end")
    asked = probes.withColumn("_at", F.floor(now / near).cast("long"))
    found = asked.join(e, [*_equal(keys, "_"), F.col("_at") == F.col("_b")]).withColumn("tier", tier).filter("tier IS NOT NULL")
    best = found.groupBy(probe).agg(F.min(F.struct("tier", rank.alias("rank"), "start_s", "event_id", fit.alias("fit"))).alias("_b"))
    best = best.select(F.col(probe).alias("_probe"), F.col("_b.event_id").alias("event_id"), F.col("_b.fit").alias("fit"))
    return probes.join(best, F.col(probe) == F.col("_probe"), "left").drop("_probe")


def candidates_around(events: DataFrame, at: Column, window: int) -> DataFrame:
    """Events (start_s, end_s) that overlap the time from `window` before the instant to `window` after it."""
    return events.filter((F.col("start_s") < at + window) & (F.col("end_s") > at - window))


def overlapping_slots(turns: DataFrame, keys: list[str], slot: str = "slot", width: float = 600) -> DataFrame:
    """Pairs of slots that were heard at once, in both directions: keys, slot, other.

    A slot's own overlapping turns become one before slots meet, and two stretches meet in the bucket of the later start.
    """
    w = Window.partitionBy(*keys, slot).orderBy("start_s", "end_s")
    before = F.max("end_s").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = turns.withColumn("_g", F.sum(F.when(F.col("start_s") <= before, 0).otherwise(1)).over(w))
    whole = apart.groupBy(*keys, slot, "_g").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).filter("end_s > start_s").drop("_g")
    mine = whole.withColumn("b", F.explode(buckets(F.col("start_s"), F.col("end_s"), width)))
    other = mine.select(*_renamed(keys, "_"), F.col(slot).alias("other"), F.col("start_s").alias("_s"), F.col("end_s").alias("_e"), F.col("b").alias("_b"))
    later = F.floor(F.greatest("start_s", "_s") / width).cast("long")
    cond = [*_equal(keys, "_"), F.col("b") == F.col("_b"), F.col("b") == later, F.col("start_s") < F.col("_e"), F.col("_s") < F.col("end_s"), F.col(slot) < F.col("other")]
    pairs = mine.join(other, cond).select(*keys, slot, "other").distinct()
    return pairs.unionByName(pairs.select(*keys, F.col("other").alias(slot), F.col(slot).alias("other")))


def point_lookup(turns: DataFrame, probes: DataFrame, key: str, width: float = 60) -> DataFrame:
    """What is heard at an instant. turns: key, seq, start_s, end_s, cluster; probes: key, at_s (whole seconds).

    A turn whose start's whole second is the instant comes before one that holds it; then the earlier start, then order.
    result: cluster, no_cluster, silence, or past_end from the last end on. heard holds the clusters of all turns that
    answer, in their order, and voices counts them.
    """
    t = turns.select(F.col(key).alias("_k"), "seq", "start_s", "end_s", "cluster")
    t = t.withColumn("_b", F.explode(buckets(F.floor("start_s"), F.greatest("start_s", "end_s"), width)))
    ends = turns.groupBy(F.col(key).alias("_ke")).agg(F.max("end_s").alias("_last"))
    tier = F.when(F.floor("start_s") == F.col("at_s"), 1).when((F.col("start_s") <= F.col("at_s")) & (F.col("at_s") < F.col("end_s")), 2)
    asked = probes.withColumn("_at", F.floor(F.col("at_s") / width).cast("long"))
    hit = asked.join(t, (F.col(key) == F.col("_k")) & (F.col("_at") == F.col("_b"))).withColumn("_tier", tier).filter("_tier IS NOT NULL")
    each = hit.groupBy(F.col(key).alias("_kb"), F.col("at_s").alias("_ab"), "cluster").agg(F.min(F.struct("_tier", "start_s", "seq")).alias("_o"), F.min("seq").alias("_q"))
    best = each.groupBy("_kb", "_ab").agg(
        F.min(F.struct("_o", "cluster")).alias("_b"), F.transform(F.array_sort(F.collect_list(F.when(F.col("cluster").isNotNull(), F.struct("_q", "cluster")))), lambda s: s["cluster"]).alias("heard")
    )
    out = probes.join(best, (F.col(key) == F.col("_kb")) & (F.col("at_s") == F.col("_ab")), "left").join(ends, F.col(key) == F.col("_ke"), "left")
    result = F.when(F.col("_b.cluster").isNotNull(), "cluster").when(F.col("_b").isNotNull(), "no_cluster").when(F.col("at_s") >= F.col("_last"), "past_end").otherwise("silence")
    voices = F.when(F.col("heard").isNull(), 0).otherwise(F.size("heard"))
    return out.select(key, "at_s", result.alias("result"), F.col("_b.cluster").alias("cluster"), F.col("_b._o.seq").alias("seq"), voices.alias("voices"), F.coalesce("heard", F.array().cast(best.schema["heard"].dataType)).alias("heard"))


def voice_at_time(looked_up: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The voice that an instant selects: looked_up as point_lookup gives it, known (key, cluster) the voices of the session.

    status: ok with its cluster; several where more than one voice answers; unknown_voice where the table of voices lacks
    it; else what point_lookup says (no_cluster, silence, past_end).
    """
    k = known.select(F.col(key).alias("_k"), F.col("cluster").alias("_c")).distinct()
    out = looked_up.join(k, (F.col(key) == F.col("_k")) & (F.col("cluster") == F.col("_c")), "left")
    status = F.when(F.col("result") != "cluster", F.col("result")).when(F.col("voices") > 1, "several").when(F.col("_c").isNull(), "unknown_voice").otherwise("ok")
    return out.select(key, "at_s", status.alias("status"), F.when(status == "ok", F.col("cluster")).alias("cluster"))


def nearest_turn(turns: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """The turn nearest to an instant (key, at_s): seq and gap_s, 0 inside a turn; ties go to the first in order.

    Besides the turns that hold the instant only the one that ended last before it and the one that starts first after it
    can be nearest, so each probe meets three turns at most.
    """
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    found = []
    for sign, edge in ((1, "end_s"), (-1, "start_s")):
        line = turns.select(key, (sign * F.col(edge)).cast("double").alias("at"), F.lit(0).alias("asks"), "seq", F.lit(None).cast(probes.schema["at_s"].dataType).alias("at_s"))
        line = line.unionByName(probes.select(key, (sign * F.col("at_s")).cast("double").alias("at"), F.lit(1).alias("asks"), none("seq", turns), "at_s"))
        w = Window.partitionBy(key).orderBy("at", "asks", F.desc("seq"))
        last = F.last(F.when(F.col("asks") == 0, F.struct("at", "seq")), ignorenulls=True).over(w)
        found.append(line.withColumn("_l", last).filter("asks = 1 AND _l IS NOT NULL").select(key, "at_s", (F.col("at") - F.col("_l.at")).alias("gap_s"), F.col("_l.seq").alias("seq")))
    inside = point_holders(turns, probes, key)
    near = found[0].unionByName(found[1]).unionByName(inside).groupBy(key, "at_s").agg(F.min(F.struct("gap_s", "seq")).alias("_n"))
    return near.select(key, "at_s", F.col("_n.seq").alias("seq"), F.col("_n.gap_s").alias("gap_s"))


def point_holders(turns: DataFrame, probes: DataFrame, key: str, width: float = 60) -> DataFrame:
    """Turns that hold an instant, both ends included: key, at_s, gap_s (0), seq."""
    t = turns.select(F.col(key).alias("_k"), "seq", "start_s", "end_s").withColumn("_b", F.explode(buckets(F.col("start_s"), F.col("end_s"), width)))
    asked = probes.withColumn("_at", F.floor(F.col("at_s") / width).cast("long"))
    held = asked.join(t, (F.col(key) == F.col("_k")) & (F.col("_at") == F.col("_b")) & F.col("at_s").between(F.col("start_s"), F.col("end_s")))
    return held.select(key, "at_s", F.lit(0.0).alias("gap_s"), "seq")


def snippets(turns: DataFrame, keys: list[str], offset: Column, most: int = 100) -> DataFrame:
    """What each voice of the speaker's track said: turns (keys, track, cluster, start_s, end_s, text) with text trimmed and cut to
    `most` characters, empty ones left out, and times moved back by the track's offset: snippet, at_s, duration_s."""
    said = F.substring(F.trim("text"), 1, most)
    at = F.greatest(F.col("start_s") - offset, F.lit(0.0))
    shown = turns.filter((F.col("track") == "speaker") & F.col("cluster").isNotNull() & (F.trim("text") != ""))
    return shown.withColumn("snippet", said).withColumn("at_s", at).withColumn("duration_s", F.greatest(F.col("end_s") - offset, at) - at)


def running_placement(pieces: DataFrame, keys: list[str], order: str, size: str, gap: float) -> DataFrame:
    """Where each piece starts when pieces are put after each other with a gap: placed_s."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return pieces.withColumn("placed_s", F.coalesce(F.sum(F.col(size) + gap).over(before), F.lit(0.0)))


def built_tracks(sessions: DataFrame, pieces: DataFrame, order: str, size: str, gap: float = 0.5, silence: float = 1.0) -> DataFrame:
    """The speaker and mic tracks of new sessions: session, track, order, placed_s, length_s and silent.

    sessions: session; pieces: session, track (speaker or mic), order and size in seconds. A track's pieces follow each other
    with a gap; a session without mic pieces gets one piece of silence there, and one without speaker pieces fails, as there is
    nothing to measure. Pieces of other sessions or tracks go; equal pieces count each; no sessions, no rows.
    """
    wanted = sessions.select("session").distinct()
    named = wanted.join(pieces.filter(F.col("track").isin("speaker", "mic")).select(F.col("session").alias("_s"), "track", order, size), F.col("session") == F.col("_s"), "left")
    has = named.groupBy("session").agg(F.count_if(F.col("track") == "speaker").alias("speaker"), F.count_if(F.coalesce(F.col("track") == "mic", F.lit(False))).alias("mic"))
    checked = has.withColumn("_ok", F.when(F.col("speaker") > 0, True).otherwise(F.raise_error(F.concat(F.lit("no audio for session "), F.col("session").cast("string"))).cast("boolean"))).filter("_ok")
    placed = running_placement(named.filter("track IS NOT NULL").drop("_s"), ["session", "track"], order, size, gap)
    out = placed.join(checked.select("session"), "session").select("session", "track", order, "placed_s", F.col(size).cast("double").alias("length_s"), F.lit(False).alias("silent"))
    quiet = checked.filter("mic = 0").select("session", F.lit("mic").alias("track"), F.lit(None).cast(pieces.schema[order].dataType).alias(order), F.lit(0.0).alias("placed_s"), F.lit(silence).alias("length_s"), F.lit(True).alias("silent"))
    return out.unionByName(quiet)
