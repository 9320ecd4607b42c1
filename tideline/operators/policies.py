"""A sweep over ways to keep references: each recording against references built from two others of its speaker."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import vectors as V

POLICIES = ("replace", "average", "set")


def policy_sweep(items: DataFrame, cut: float, keys: list[str]) -> DataFrame:
    """For each policy, how a recording (speaker, session, embedding) is decided when its speaker is known from two others.

    Speakers with three sessions or more are targets; each of their recordings is the probe, and every ordered pair of the
    rest is what is known: `replace` keeps the second, `average` the unit mean, `set` both. Everybody else of the same key is
    known by the first of their sessions other than the probe's (impostors; those that have no other session are refused and counted).
    A probe is correct if the nearest reference is its speaker's and under the cut, wrong if another's is, refused otherwise;
    open tells the same without its speaker's references: accepted if an impostor is under the cut. Distances go with the probe
    and one recording (or one mean of two), so a pair costs no more than two looked-up distances: the inner product with a mean
    is the mean of inner products over the mean's length.

    Gives keys, policy, combinations, correct, wrong, refused, open_accepted, impostors_refused.
    """
    it = items.select(*keys, "speaker", "session", "embedding")
    targets = it.groupBy(*keys, "speaker").agg(F.count("*").alias("_n")).filter("_n >= 3").drop("_n")
    probes = it.join(targets, [*keys, "speaker"])
    mark = lambda df, m: df.select(*[F.col(k).alias(f"{m}{k}") for k in keys], F.col("speaker").alias(f"{m}speaker"), F.col("session").alias(f"{m}session"), F.col("embedding").alias(f"{m}e"))
    same = lambda m: [F.col(k) == F.col(f"{m}{k}") for k in keys]

    others = mark(it, "_o")
    met = probes.join(others, same("_o")).filter(F.col("speaker") != F.col("_ospeaker"))
    first = met.groupBy(*keys, "speaker", "session", "_ospeaker").agg(
        F.min(F.when(F.col("_osession") != F.col("session"), F.struct("_osession", V.cosine_distance(F.col("embedding"), F.col("_oe")).alias("d")))).alias("_f")
    )
    impostors = first.groupBy(*keys, "speaker", "session").agg(F.min("_f.d").alias("impostor"), F.count_if(F.col("_f").isNull()).alias("no_impostor"))

    own = mark(it, "_a")
    near = probes.join(own, [*same("_a"), F.col("speaker") == F.col("_aspeaker"), F.col("session") != F.col("_asession")])
    near = near.select(*keys, "speaker", "session", F.col("_asession").alias("one"), V.dot(F.col("embedding"), F.col("_ae")).alias("s"), F.col("_ae").alias("e"))
    two = near.select(*[F.col(k).alias(f"_b{k}") for k in keys], F.col("speaker").alias("_bspeaker"), F.col("session").alias("_bsession"), F.col("one").alias("two"), F.col("s").alias("t"), F.col("e").alias("f"))
    pair = near.join(two, [*same("_b"), F.col("speaker") == F.col("_bspeaker"), F.col("session") == F.col("_bsession"), F.col("one") != F.col("two")])
    mean = (F.col("s") + F.col("t")) / F.sqrt(V.dot(F.col("e"), F.col("e")) + V.dot(F.col("f"), F.col("f")) + 2 * V.dot(F.col("e"), F.col("f")))
    near_of = {"replace": 1 - F.col("t"), "average": 1 - mean, "set": 1 - F.greatest("s", "t")}
    pair = pair.join(impostors, [*keys, "speaker", "session"], "left")
    each = pair.select(*keys, "impostor", "no_impostor", F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), near_of[p].alias("mine")) for p in POLICIES])).alias("x")).select(*keys, "impostor", "no_impostor", "x.*")
    far = F.coalesce("impostor", F.lit(float("inf")))
    hit = F.least("mine", far) < cut
    return each.groupBy(*keys, "policy").agg(
        F.count("*").alias("combinations"), F.count_if(hit & (F.col("mine") <= far)).alias("correct"), F.count_if(hit & (F.col("mine") > far)).alias("wrong"), F.count_if(~hit).alias("refused"),
        F.count_if(far < cut).alias("open_accepted"), F.coalesce(F.sum("no_impostor"), F.lit(0)).alias("impostors_refused"),
    )
