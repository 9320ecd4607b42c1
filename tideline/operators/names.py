"""Names and labels: profiles, prompts, resolution of typed names, and updates of label tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.operators import vectors as vec


def profile_match(sessions: DataFrame, profiles: DataFrame, shared: Column) -> DataFrame:
    """The vocabulary of each session: sessions (session, explicit, title), profiles (profile, match_title, terms), shared terms.

    An explicit name counts, else the one profile whose pattern is found in the title. Gives session, status (ok, none, unknown or
    several), profile and terms: the shared ones, then the profile's.
    """
    p = profiles.select("profile", "match_title", "terms")
    asked = sessions.filter("explicit IS NOT NULL").select("session", F.col("explicit").alias("profile"))
    found = vec.against(sessions.filter("explicit IS NULL AND title IS NOT NULL").select("session", "title"), p.filter("match_title IS NOT NULL")).filter(F.expr("title RLIKE match_title"))
    hits = asked.join(p, "profile").select("session", "profile", "terms").unionByName(found.select("session", "profile", "terms"))
    n = hits.groupBy("session").agg(F.count("*").alias("_n"), F.min(F.struct("profile", "terms")).alias("_p"))
    one = F.col("_n") == 1
    status = F.when(one, "ok").when(F.col("_n") > 1, "several").when(F.col("explicit").isNotNull(), "unknown").otherwise("none")
    terms = F.when(one, F.concat(shared, "_p.terms")).when(status == "none", shared)
    return sessions.select("session", "explicit").join(n, "session", "left").select("session", status.alias("status"), F.when(one, F.col("_p.profile")).alias("profile"), terms.alias("terms"))


def vocabulary_prompt(terms: DataFrame, keys: list[str], order: str, term: str, lead: str, most: int) -> DataFrame:
    """One prompt for each key: the lead-in, the terms with commas and a full stop, in `most` UTF-8 bytes; prompt (null without terms), dropped.

    Terms are trimmed, blank ones and repeats (any case) go; from the first that doesn't fit, all are dropped.
    """
    bare = F.trim(F.replace(F.col(term), F.lit("\0"), F.lit("")))
    t = terms.select(*keys, F.col(order).alias("_o"), bare.alias("_t")).filter("_t <> ''")
    t = t.groupBy(*keys, F.lower("_t").alias("_low")).agg(F.min(F.struct("_o", "_t")).alias("_s")).select(*keys, "_s._o", "_s._t")
    w = Window.partitionBy(*keys).orderBy("_o")
    size = len(lead.encode()) + 1 + F.sum(F.octet_length("_t") + 2).over(w) - 2
    t = t.withColumn("_fits", size <= most)
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("_fits"), F.struct("_o", "_t")))), lambda s: s["_t"])
    out = t.groupBy(*keys).agg(kept.alias("_k"), F.count_if(~F.col("_fits")).alias("dropped"))
    return out.select(*keys, F.when(F.size("_k") > 0, F.concat(F.lit(lead), F.array_join("_k", ", "), F.lit("."))).alias("prompt"), "dropped")


def name_matches(typed: DataFrame, names: DataFrame) -> DataFrame:
    """Typed texts beside the names that they are like: typed (typed, folded), names (name, folded). Gives typed, name and rank:
    0 same, 1 prefix, 2 prefix of a word, 3 near miss (as many edits as edit_budget allows); the best kind of each pair.

    All four are equi-joins: prefixes on the prefixes of names and of their words, near misses on what is left of both
    without the characters that may differ; only pairs that share one of these are measured.
    """
    t = typed.select("typed").filter("typed <> ''").distinct()
    n = names.select("name").filter("name IS NOT NULL").distinct()
    starts = n.select("name", F.explode(T.prefixes(F.col("name"))).alias("typed")).withColumn("rank", F.when(F.col("typed") == F.col("name"), 0).otherwise(1))
    words = n.select("name", F.explode(F.split("name", " ")).alias("word")).distinct().select("name", F.explode(T.prefixes(F.col("word"))).alias("typed"), F.lit(2).alias("rank"))
    exact = t.join(starts.unionByName(words), "typed").groupBy("typed", "name").agg(F.min("rank").alias("rank"))
    budget = T.edit_budget(F.col("typed"))
    left = [t.filter(budget == most).select("typed", F.explode(T.without_characters(F.col("typed"), most)).alias("rest")) for most in (1, 2)]
    near = left[0].unionByName(left[1]).join(n.select("name", F.explode(T.without_characters(F.col("name"), 2)).alias("rest")), "rest").select("typed", "name").distinct()
    near = near.join(exact, ["typed", "name"], "left_anti").filter(F.levenshtein("typed", "name") <= 2 * budget)
    near = near.withColumn("edits", T.osa_distance(F.col("typed"), F.col("name"))).filter(F.col("edits") <= budget).select("typed", "name", F.lit(3).alias("rank"))
    return exact.unionByName(near)


def resolve_names(typed: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """What a typed name means: typed (key, typed), names (name). Gives key, result (blank, enrolled, new or candidates), name and candidates.

    enrolled: exactly one name equals it but for case and spaces. Candidates go by likeness, length, then name. A null text
    is blank; repeated names count once.
    """
    folded = typed.select(key, F.trim("typed").alias("typed"), F.coalesce(T.folded(F.col("typed")), F.lit("")).alias("_f"))
    known = names.select("name", T.folded(F.col("name")).alias("_n")).distinct()
    found = name_matches(folded.select(F.col("_f").alias("typed")), known.select(F.col("_n").alias("name")))
    pairs = folded.select(key, "_f").join(found.select(F.col("typed").alias("_f"), F.col("name").alias("_n"), "rank"), "_f").join(known, "_n")
    g = pairs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), F.char_length("name").alias("n"), F.col("name")))).alias("_c"), F.count_if(F.col("rank") == 0).alias("_same"), F.min(F.when(F.col("rank") == 0, F.col("name"))).alias("_one"))
    result = F.when(F.col("_f") == "", "blank").when(F.col("_same") == 1, "enrolled").when(F.col("_c").isNull(), "new").otherwise("candidates")
    out = folded.join(g, key, "left").withColumn("result", result)
    return out.select(key, "result", F.when(F.col("result") == "enrolled", F.col("_one")).when(F.col("result") == "new", F.col("typed")).alias("name"), F.when(F.col("result") == "candidates", F.transform("_c", lambda c: c["name"])).alias("candidates"))


def updated_labels(changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Labels and denials after changes in order (keys, action, name): assign, deny or forget. Gives keys, kind (assigned or denied), name.

    assign replaces the key's name and clears a denial of that name; deny adds a denial; forget clears both.
    """
    last = F.max(F.when(F.col("action") == "forget", F.col(order))).over(Window.partitionBy(*keys))
    live = changes.withColumn("_f", last).filter((F.col("action") != "forget") & (F.col("_f").isNull() | (F.col(order) > F.col("_f"))))
    named = live.filter("action = 'assign'").groupBy(*keys).agg(F.max_by("name", order).alias("name")).select(*keys, F.lit("assigned").alias("kind"), "name")
    denied = live.groupBy(*keys, "name").agg(F.max_by("action", order).alias("_a")).filter("_a = 'deny'").select(*keys, F.lit("denied").alias("kind"), "name")
    return named.unionByName(denied)


def forget_vectors(references: DataFrame, forgotten: DataFrame) -> DataFrame:
    """References (name, embedding) without the forgotten vectors (embedding, keep_name), but for the name that keeps them; remaining counts a name's rest."""
    gone = forgotten.select(F.col("embedding").alias("_v"), F.col("keep_name").alias("_k")).distinct()
    kept = references.join(gone, (references["embedding"] == gone["_v"]) & ~references["name"].eqNullSafe(gone["_k"]), "left_anti")
    return kept.withColumn("remaining", F.count("*").over(Window.partitionBy("name")))


def without_person(references: DataFrame, names: DataFrame) -> DataFrame:
    """References without all those of some names."""
    return references.join(names.select("name").distinct(), "name", "left_anti")


def without_reference(references: DataFrame, removed: DataFrame, order: str) -> DataFrame:
    """References without some of a name's, given by their number among that name's in order: removed (name, handle from 1)."""
    n = references.withColumn("handle", F.row_number().over(Window.partitionBy("name").orderBy(order)))
    return n.join(removed.select("name", "handle").distinct(), ["name", "handle"], "left_anti").drop("handle")


def names_by_appearance(rows: DataFrame, order: str) -> DataFrame:
    """Different names with where each appears first: name, first. Sort by first, then name, to have them in order; rows without a name go."""
    return rows.filter("name IS NOT NULL").groupBy("name").agg(F.min(order).alias("first"))


def group_members(asked: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """The clusters that asked labels (keys, label) mean, by first appearance: labels (keys, id, label, first_s). members is null where any label is unknown."""
    a = asked.select(*keys, "label").distinct().join(labels, [*keys, "label"], "left")
    g = a.groupBy(*keys).agg(F.count_if(F.col("id").isNull()).alias("_bad"), F.array_sort(F.collect_set(F.when(F.col("id").isNotNull(), F.struct("first_s", "id")))).alias("_m"))
    return g.select(*keys, F.when(F.col("_bad") == 0, F.transform("_m", lambda s: s["id"])).alias("members"))


def unanswered(voices: DataFrame, answered: DataFrame, keys: list[str]) -> DataFrame:
    """Voices (keys, id, named) that got no answer, counted by whether they have a name."""
    left = voices.join(answered.select(*keys, "id").distinct(), [*keys, "id"], "left_anti")
    return left.groupBy(*keys).agg(F.count_if("named").alias("left_named"), F.count_if(~F.col("named")).alias("left_unnamed"))


def relabelled(turns: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Turns (keys, track, cluster, speaker) with the new label of their cluster on the speaker's track; changed tells whether it differs."""
    new = labels.select(*keys, F.col("id").alias("cluster"), F.col("label").alias("_new"))
    shown = F.when(F.col("track") == "speaker", F.coalesce("_new", "speaker")).otherwise(F.col("speaker"))
    return turns.join(new, [*keys, "cluster"], "left").withColumn("changed", ~shown.eqNullSafe(F.col("speaker"))).withColumn("speaker", shown).drop("_new")
