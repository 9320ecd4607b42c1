"""Voices of a session: assembly, representatives, prompts, and trials of how references are kept."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import vectors as V
from tideline.operators import assign
from tideline.operators import vectors as vec


def assemble(turns: DataFrame, keys: list[str], slot: str, least: float = 0.5, vector: str | None = None) -> DataFrame:
    """Clusters of turns of at least `least`, numbered from 0 by falling speech (ties: slot): keys, id, slot, speech_s, first_s.

    With the turns' vectors, turns without one (null or empty) are left out, and a cluster has an embedding: the mean of its turns'
    vectors, each turn counting once, at length one (a zero mean stays zero). Defined cases: null keys and slots are keys and
    slots of their own; repeated turns count as often as they come; an empty table gives an empty result.
    """
    held = turns.filter(F.col("end_s") - F.col("start_s") >= least)
    if vector:
        held = held.filter(F.size(vector) > 0)
    out = held.groupBy(*keys, slot).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("speech_s"), F.min("start_s").alias("first_s"))
    if vector:
        means = vec.group_means(held, [*keys, slot], vector)
        names = [*keys, slot]
        means = means.select(*[F.col(k).alias(f"_{k}") for k in names], F.coalesce("unit", "mean").alias("embedding"))
        same = [out[k].eqNullSafe(means[f"_{k}"]) for k in names]
        out = out.join(means, same, "left").drop(*[f"_{k}" for k in names])
    return out.withColumn("id", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("speech_s"), slot)) - 1)


def representatives(turns: DataFrame, keys: list[str], order: str, track_end: str, n: int = 3, least: float = 1.5) -> DataFrame:
    """The n longest turns (ties: earlier in order), widened on both sides to `least` and moved back into the track: rep_start_s, rep_end_s."""
    size = F.col("end_s") - F.col("start_s")
    top = turns.withColumn("rep", F.row_number().over(Window.partitionBy(*keys).orderBy(size.desc(), order))).filter(F.col("rep") <= n)
    start = F.greatest(F.col("start_s") - (least - size) / 2, F.lit(0.0))
    late, short = start + least > F.col(track_end), size < least
    moved = F.when(late, F.greatest(F.col(track_end) - least, F.lit(0.0))).otherwise(start)
    end = F.when(late, F.col(track_end)).otherwise(start + least)
    return top.withColumn("rep_start_s", F.when(short, moved).otherwise(F.col("start_s"))).withColumn("rep_end_s", F.when(short, end).otherwise(F.col("end_s")))


def unknown_numbers(clusters: DataFrame, keys: list[str]) -> DataFrame:
    """Unknown N by first appearance (ties: id): adds label."""
    return clusters.withColumn("label", F.concat(F.lit("Unknown "), F.row_number().over(Window.partitionBy(*keys).orderBy("first_s", "id"))))


def prompt_queue(voices: DataFrame, keys: list[str], floor: float = 5.0, with_named: bool = False, with_quiet: bool = False) -> DataFrame:
    """Voices to ask about, numbered by first appearance: those without a name and not settled, of `floor` seconds or more.

    voices: keys, id, first_s, speech_s, named, tentative, denied. Settled is a short voice with a tentative name or a denial. Where
    no voice of a session reaches the floor, all of its candidates are asked about.
    """
    settled = (F.col("speech_s") < floor) & (F.col("tentative") | F.col("denied"))
    found = voices.filter((F.lit(with_named) | ~F.col("named")) & (F.lit(with_named or with_quiet) | ~settled))
    enough = F.lit(with_quiet) | (F.col("speech_s") >= floor)
    found = found.withColumn("_any", F.max(enough).over(Window.partitionBy(*keys))).filter(enough | ~F.col("_any")).drop("_any")
    return found.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("first_s", "id")))


def pick_voice(asked: DataFrame, voices: DataFrame, keys: list[str]) -> DataFrame:
    """The voice that a text means: asked (keys, typed), voices (keys, id, number_label, shown). A whole number N means Unknown N.

    Gives keys, typed, status (ok, none or several) and the id where it is one.
    """
    wanted = F.when(F.trim("typed").rlike("^[0-9]+$"), F.concat(F.lit("Unknown "), F.trim("typed").cast("long"))).otherwise(F.trim("typed"))
    both = voices.select(*keys, "id", F.explode(F.array_distinct(F.array("number_label", "shown"))).alias("_w"))
    met = asked.withColumn("_w", wanted).join(both, [*keys, "_w"], "left").groupBy(*keys, "typed").agg(F.count_distinct("id").alias("_n"), F.min("id").alias("_id"))
    return met.select(*keys, "typed", F.when(F.col("_n") == 0, "none").when(F.col("_n") == 1, "ok").otherwise("several").alias("status"), F.when(F.col("_n") == 1, F.col("_id")).alias("id"))


def one_speaker_cost(clusters: DataFrame, conflicts: DataFrame, keys: list[str]) -> DataFrame:
    """What it would mean to call all voices of a session one: voices, and those that conflict with an earlier one (first_s, id)."""
    a = clusters.select(*keys, F.col("id").alias("a"), F.struct("first_s", "id").alias("_a"))
    b = clusters.select(*keys, F.col("id").alias("b"), F.struct("first_s", "id").alias("_b"))
    later = assign.symmetric(conflicts, keys).join(a, [*keys, "a"]).join(b, [*keys, "b"]).filter("_b < _a").groupBy(*keys).agg(F.count_distinct("a").alias("overridden"))
    return clusters.groupBy(*keys).agg(F.count("*").alias("voices")).join(later, keys, "left").fillna(0, ["overridden"])


def policy_references(references: DataFrame, name: str, order: str, embedding: str) -> DataFrame:
    """References under three ways of keeping them (policy, name, embedding): replace (the last), average (unit mean) and set (all)."""
    all_ = references.select(F.lit("set").alias("policy"), name, F.col(embedding).cast("array<double>").alias("embedding"))
    last = references.groupBy(name).agg(F.max_by(embedding, order).cast("array<double>").alias("embedding")).select(F.lit("replace").alias("policy"), name, "embedding")
    mean = vec.group_means(references.withColumnRenamed(embedding, "embedding"), [name]).select(F.lit("average").alias("policy"), name, F.col("unit").alias("embedding"))
    return all_.unionByName(last).unionByName(mean.filter("embedding IS NOT NULL"))


def distance_populations(items: DataFrame, speaker: str, order: str, embedding: str, references: int = 2) -> DataFrame:
    """Each later recording of a speaker against everybody's first ones: probe, speaker, other, distance (least), own."""
    n = items.withColumn("_n", F.row_number().over(Window.partitionBy(speaker).orderBy(order)))
    refs = n.filter(F.col("_n") <= references).select(F.col(speaker).alias("other"), F.col(embedding).alias("_e"))
    probes = n.filter(F.col("_n") > references).select(F.col(order).alias("probe"), F.col(speaker).alias("speaker"), F.col(embedding).alias("_p"))
    near = vec.against(probes, refs).groupBy("probe", "speaker", "other").agg(F.min(V.cosine_distance(F.col("_p"), F.col("_e"))).alias("distance"))
    return near.withColumn("own", F.col("speaker") == F.col("other"))


def identification_report(nearest: DataFrame, cut: float, enrolled: Column) -> DataFrame:
    """Counts over probes (speaker, name of the nearest reference, distance): named_right, named_wrong, refused, strangers_named and strangers_refused."""
    hit = F.col("distance") < cut
    return nearest.agg(
        F.count_if(enrolled & hit & (F.col("name") == F.col("speaker"))).alias("named_right"), F.count_if(enrolled & hit & (F.col("name") != F.col("speaker"))).alias("named_wrong"),
        F.count_if(enrolled & ~hit).alias("refused"), F.count_if(~enrolled & hit).alias("strangers_named"), F.count_if(~enrolled & ~hit).alias("strangers_refused"),
    )


def group_distances(members: DataFrame, group: str, embedding: str) -> DataFrame:
    """Distances of groups (a < b) of vectors of length one: average linkage, distance of the unit means, and the shrinkage between them.

    The mean of all cross products is the product of the two mean vectors, so pairs of members are never formed.
    """
    m = vec.group_means(members.withColumnRenamed(embedding, "embedding"), [group]).filter("length > 0").select(group, "unit", "length")
    a, b = m.select(F.col(group).alias("a"), F.col("unit").alias("_u"), F.col("length").alias("_l")), m.select(F.col(group).alias("b"), F.col("unit").alias("_v"), F.col("length").alias("_k"))
    met = a.join(b, F.col("a") < F.col("b")).withColumn("centroid", V.cosine_distance(F.col("_u"), F.col("_v"))).withColumn("shrinkage", F.col("_l") * F.col("_k"))
    return met.select("a", "b", (1 - F.col("shrinkage") * (1 - F.col("centroid"))).alias("average"), "centroid", "shrinkage")
