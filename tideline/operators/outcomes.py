"""What an answer would leave behind: the reference that is stored, those that others lose, and what a user is told of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import text as T

#: References that a name may hold, and the seconds of speech under which a voice becomes none.
MOST, FLOOR = 10, 5.0
#: The sentences a user is told, as format strings.
SENTENCES = {
    "enrolled": "enrols them, from this voice",
    "added": "stores another recording of them, %d in all",
    "already_held": "stores nothing new: they already hold this recording",
    "replaced": "stores this recording in place of their shortest, %s, %d in all",
    "at_capacity": "stores nothing: they hold %d recordings and none is shorter than this voice",
    "session_only": "names this voice in this session only, storing no reference",
    "displaced": "takes a recording off %s, leaving them %d",
    "stale": "leaves a recording of this voice standing under %s",
    "kept": "unavailable: %s was heard at the same time as this voice and would keep the name",
    "refused": "unavailable: the name would not end up on this voice",
    "taken": "unavailable: %s would stop reading %s",
    "blank": "a name of nothing but spaces writes nothing",
}


def outcomes(answers: DataFrame, references: DataFrame, keys: list[str], most: int = MOST, floor: float = FLOOR, always: bool = False) -> DataFrame:
    """What each answer alone would do to the references: answers (keys, id, name, embedding, speech_s) against references (name,
    embedding, clip_s).

    From `floor` seconds on (or always) the voice's exact vector goes from under all other names (displaced: name, remaining) and
    is stored: enrolled for a new name, added below `most`, already_held where the name has this vector, replaced where the
    name's shortest measured reference is shorter (evicted_s), else at_capacity (shortest_s). Under the floor nothing is stored,
    and other names that hold the vector are stale. Adds stored, held, evicted_s, shortest_s, session_only, displaced and stale.

    Answers meet references in equi-joins on the name and on the vector; a name's references are counted first. Defined cases: names
    are trimmed; a blank or null name is a skip, of which all columns but keys, id and name are null; a null vector is held by nobody;
    a null speech_s is under the floor; a reference without clip_s is never the shortest; references without a name don't count;
    displaced and stale are in order of name; equal answers are one; without references every name is new.
    """
    name = F.nullif(T.trimmed(F.col("name")), F.lit(""))
    asked = answers.select(*keys, "id", name.alias("name"), "embedding", F.coalesce(F.col("speech_s"), F.lit(0.0)).alias("_s")).distinct()
    known = references.filter("name IS NOT NULL")
    held = known.groupBy("name").agg(F.count("*").alias("_n"), F.min("clip_s").alias("_least"))
    copies = known.groupBy(F.col("embedding").alias("_v"), F.col("name").alias("_of")).agg(F.count("*").alias("_c"))
    others = copies.join(held.select(F.col("name").alias("_of"), F.col("_n").alias("_all")), "_of").select("_v", "_of", (F.col("_all") - F.col("_c")).alias("_left"))
    met = asked.join(others, asked["embedding"] == others["_v"], "left")
    other = F.col("_of") != F.col("name")
    rows = met.groupBy(*keys, "id", "name", "_s").agg(
        F.coalesce(F.bool_or(F.col("_of") == F.col("name")), F.lit(False)).alias("_known"),
        F.array_sort(F.collect_set(F.when(other, F.struct(F.col("_of").alias("name"), F.col("_left").alias("remaining"))))).alias("_others"),
    )
    out = rows.join(held, "name", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    asks, kept, longer = F.col("name").isNotNull(), F.lit(always) | (F.col("_s") >= floor), F.col("_s") > F.col("_least")
    stored = (
        F.when(F.col("_known"), "already_held").when(F.col("_n") == 0, "enrolled").when(F.col("_n") < most, "added")
        .when(longer, "replaced").otherwise("at_capacity")
    )
    out = out.withColumn("stored", F.when(asks & kept, stored))
    total = F.when(F.col("stored") == "added", F.col("_n") + 1).when(F.col("stored").isin("replaced", "at_capacity"), F.col("_n"))
    none = F.col("_others").getField("name")
    return out.select(
        *keys, "id", "name", "stored", total.alias("held"), F.when(F.col("stored") == "replaced", F.col("_least")).alias("evicted_s"), F.when(F.col("stored") == "at_capacity", F.col("_least")).alias("shortest_s"),
        F.when(asks, F.col("stored").isNull() | (F.col("stored") == "at_capacity")).alias("session_only"),
        F.when(asks, F.when(kept, F.col("_others")).otherwise(F.slice("_others", 1, 0))).alias("displaced"), F.when(asks, F.when(kept, F.slice(none, 1, 0)).otherwise(none)).alias("stale"),
    )


def sentences() -> Column:
    """The lines that a user reads of a row of outcomes with verdict, other_number and losing: the refusal alone where there is one."""
    say = lambda k, *of: F.format_string(SENTENCES[k], *of) if of else F.lit(SENTENCES[k])
    refusal = F.when(F.col("verdict") == "taken", say("taken", F.col("other_number"), F.col("losing"))).when(F.col("verdict") == "vetoed", F.coalesce(F.when(F.col("other_number").isNotNull(), say("kept", F.col("other_number"))), say("refused")))
    did = (
        F.when(F.col("stored") == "added", say("added", F.col("held"))).when(F.col("stored") == "replaced", say("replaced", T.spoken(F.col("evicted_s")), F.col("held")))
        .when(F.col("stored") == "at_capacity", say("at_capacity", F.col("held"))).when(F.col("stored") == "enrolled", say("enrolled")).when(F.col("stored") == "already_held", say("already_held"))
    )
    would = F.concat(
        F.array_compact(F.array(did, F.when(F.col("session_only"), say("session_only")))),
        F.transform("displaced", lambda d: F.format_string(SENTENCES["displaced"], d["name"], d["remaining"])),
        F.transform("stale", lambda s: F.format_string(SENTENCES["stale"], s)),
    )
    return F.when(F.col("name").isNull(), F.array(say("blank"))).when(refusal.isNotNull(), F.array(refusal)).otherwise(would)
