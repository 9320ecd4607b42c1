"""Meetings and processes: which events may be offered, who is recorded, rosters, and what counts as someone else's activity.

Rows with nulls: a null flag counts as not set; an attendee list that is null is empty. Ties are settled by start, then id.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fits under which the invited attendees are taken for those present.
STRONG = ("confirmed", "started")


def usable(events: DataFrame) -> DataFrame:
    """Events (all_day, cancelled, attendees array<struct<is_you, status>>) that can have been the meeting: not all-day, not
    cancelled, and not declined by the user; what others answered does not count."""
    refused = F.coalesce(F.exists("attendees", lambda a: F.coalesce(a["is_you"], F.lit(False)) & F.coalesce(a["status"] == "declined", F.lit(False))), F.lit(False))
    return events.filter(~F.coalesce("all_day", F.lit(False)) & ~F.coalesce("cancelled", F.lit(False)) & ~refused)


def offered(events: DataFrame, keys: list[str]) -> DataFrame:
    """Usable events in the order in which they are offered, by start and event id: adds place."""
    return usable(events).withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("start_s", "event_id")))


def excluded(processes: DataFrame, bundles: DataFrame, executables: DataFrame) -> DataFrame:
    """Adds by_bundle and by_executable: whether the process is on the lists of exact bundle ids and executables (column value).
    An unreadable (null) fact is on no list."""
    b = bundles.select(F.col("value").alias("_b")).filter("_b IS NOT NULL").distinct()
    e = executables.select(F.col("value").alias("_e")).filter("_e IS NOT NULL").distinct()
    met = processes.join(b, F.col("bundle_id") == F.col("_b"), "left").join(e, F.col("executable") == F.col("_e"), "left")
    return met.withColumn("by_bundle", F.col("_b").isNotNull()).withColumn("by_executable", F.col("_e").isNotNull()).drop("_b", "_e")


def bearing(processes: DataFrame, our_pid: Column, our_executable: Column, helpers: list[str]) -> DataFrame:
    """What each process (pid, bundle_id, executable, by_bundle, by_executable) means: the first of pid_unknown, own, helper, bundle,
    own_executable and executable that holds, else activity. A null pid excludes; other unreadable facts count as activity."""
    is_helper = F.coalesce(F.col("bundle_id").isin(*helpers), F.lit(False)) if helpers else F.lit(False)
    kind = (
        F.when(F.col("pid").isNull(), "pid_unknown").when(F.col("pid") == our_pid, "own").when(is_helper, "helper").when(F.col("by_bundle"), "bundle")
        .when(F.col("executable") == our_executable, "own_executable").when(F.col("by_executable"), "executable").otherwise("activity")
    )
    return processes.withColumn("bearing", kind)


def someone_captures(processes: DataFrame, keys: list[str]) -> DataFrame:
    """Whether any process of a snapshot that captures is someone else's activity: keys, capturing."""
    return processes.groupBy(*keys).agg(F.coalesce(F.bool_or(F.coalesce("running", F.lit(False)) & (F.col("bearing") == "activity")), F.lit(False)).alias("capturing"))


def roster(sessions: DataFrame) -> DataFrame:
    """Adds speakers: the attendees where the event fits well, else none."""
    return sessions.withColumn("speakers", F.when(F.col("fit").isin(*STRONG), F.col("attendees")))


def settled(fit: Column, cleared: Column) -> Column:
    """Whether somebody decided by hand what the meeting was."""
    return F.coalesce(cleared, F.lit(False)) | F.coalesce(fit == "confirmed", F.lit(False))


def automatic_labels(sessions: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Sessions (key, event_id, fit, cleared) with the event that was found for them (key, event_id, fit; none takes the event
    away), but for those that were settled by hand."""
    new = found.select(F.col(key).alias("_k"), F.col("event_id").alias("_event"), F.col("fit").alias("_fit"))
    by_hand = settled(F.col("fit"), F.col("cleared"))
    out = sessions.join(new, F.col(key) == F.col("_k"), "left")
    return out.withColumns({"event_id": F.when(by_hand, F.col("event_id")).otherwise(F.col("_event")), "fit": F.when(by_hand, F.col("fit")).otherwise(F.col("_fit"))}).drop("_k", "_event", "_fit")


def labelled_by_hand(sessions: DataFrame, choices: DataFrame, offers: DataFrame, key: str) -> DataFrame:
    """Sessions (key, event_id, fit, cleared, transcribed) after choices by hand: choices (key, place), offers (key, place, event_id).

    A place takes that offered event, confirmed; a null place clears the event and says so. A place that is not offered
    changes nothing. status: labelled, cleared, not_offered or unchanged; render tells whether a transcript has to be written
    anew, which is where the event changed and there is one.
    """
    c = choices.select(F.col(key).alias("_k"), F.col("place").alias("_place"), F.lit(True).alias("_asked"))
    o = offers.select(F.col(key).alias("_ko"), F.col("place").alias("_po"), F.col("event_id").alias("_event"))
    met = sessions.join(c, F.col(key) == F.col("_k"), "left").join(o, (F.col(key) == F.col("_ko")) & (F.col("_place") == F.col("_po")), "left")
    status = F.when(F.col("_asked").isNull(), "unchanged").when(F.col("_place").isNull(), "cleared").when(F.col("_event").isNull(), "not_offered").otherwise("labelled")
    met = met.withColumn("status", status).withColumn("_was", F.col("event_id"))
    took, gone = F.col("status") == "labelled", F.col("status") == "cleared"
    out = met.withColumns({
        "event_id": F.when(took, F.col("_event")).when(gone, F.lit(None)).otherwise(F.col("event_id")), "fit": F.when(took, "confirmed").when(gone, F.lit(None)).otherwise(F.col("fit")),
        "cleared": F.when(took, False).when(gone, True).otherwise(F.col("cleared")),
    })
    return out.withColumn("render", (took | gone) & F.coalesce("transcribed", F.lit(False)) & ~F.col("event_id").eqNullSafe(F.col("_was"))).drop("_k", "_place", "_asked", "_ko", "_po", "_event", "_was")


def roster_edits(sessions: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Sessions (key, event_id, attendees) with edited attendees (key, event_id, attendees), where the edit is of the event that the
    session still has."""
    e = edits.select(F.col(key).alias("_k"), F.col("event_id").alias("_event"), F.col("attendees").alias("_new"))
    met = sessions.join(e, (F.col(key) == F.col("_k")) & (F.col("event_id") == F.col("_event")), "left")
    return met.withColumn("attendees", F.when(F.col("_k").isNotNull(), F.col("_new")).otherwise(F.col("attendees"))).drop("_k", "_event", "_new")


def identities(*lists: DataFrame) -> DataFrame:
    """Sorted distinct values of all lists, by kind: kind, values. Nulls and blanks go."""
    rows = lists[0].select("kind", "value")
    for one in lists[1:]:
        rows = rows.unionByName(one.select("kind", "value"))
    return rows.filter(F.trim("value") != "").groupBy("kind").agg(F.array_sort(F.collect_set("value")).alias("values"))


def changed_sessions(changes: DataFrame, session: str) -> DataFrame:
    """Sessions that a change touches, once each and in order."""
    return changes.select(session).filter(F.col(session).isNotNull()).distinct().orderBy(session)


def counters(rows: DataFrame, keys: list[str], status: str, kinds: list[str]) -> DataFrame:
    """How many rows of each status there are, a column for each kind in `kinds`, 0 where there is none, and all of them (n)."""
    return rows.groupBy(*keys).agg(*[F.count_if(F.col(status) == k).alias(k) for k in kinds], F.count("*").alias("n"))


def spoken(segments: DataFrame, text: str) -> DataFrame:
    """Segments with their text trimmed, without those that hold nothing or only the mark of a blank stretch."""
    bare = F.trim(F.regexp_replace(F.col(text), r"^\s+|\s+$", ""))
    return segments.withColumn(text, bare).filter(F.col(text).isNotNull() & (F.col(text) != "") & (F.col(text) != "[BLANK_AUDIO]"))
