"""The bounded cache of speaker frames: scores, boosts and the rows that stay."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pooled(logits: DataFrame, keys: list[str], frame: str, slot: str, logit: str, stack: int) -> DataFrame:
    """Mean probability of each group of `stack` frames; a shorter group at the end goes."""
    g = logits.withColumn("_f", F.floor(F.col(frame) / stack)).groupBy(*keys, F.col("_f").alias(frame), slot)
    return g.agg(F.avg(1 / (1 + F.exp(-F.col(logit)))).alias("p"), F.count("*").alias("_n")).filter(F.col("_n") == stack).drop("_n")


def frame_scores(probs: DataFrame, keys: list[str], frame: str, slot: str, p: str, least: int, floor: float = 1e-6) -> DataFrame:
    """Adds score: the log odds that the slot alone speaks in the frame, to nine digits so that the order of sums cannot decide ties.

    Null up to a probability of one half, and for scores not above zero once the slot has `least` above it.
    """
    logs = F.log(F.greatest(1 - F.col(p), F.lit(floor)))
    others = F.sum(logs).over(Window.partitionBy(*keys, frame))
    raw = F.when(F.col(p) > 0.5, F.round(F.log(F.greatest(F.col(p), F.lit(floor))) - logs + others - F.log(F.lit(0.5)), 9))
    scored = probs.withColumn("_raw", raw).withColumn("_above", F.count_if(F.col("_raw") > 0).over(Window.partitionBy(*keys, slot)))
    return scored.withColumn("score", F.when((F.col("_raw") > 0) | (F.col("_above") < least), F.col("_raw"))).drop("_raw", "_above")


def boost(scores: DataFrame, keys: list[str], frame: str, slot: str, n: int, amount: float) -> DataFrame:
    """Raises the n best frames of each slot (ties: earlier frame)."""
    best = F.row_number().over(Window.partitionBy(*keys, slot).orderBy(F.col("score").desc_nulls_last(), frame)) <= n
    return scores.withColumn("score", F.when(best, F.round(F.col("score") + amount, 9)).otherwise(F.col("score")))


def compress(probs: DataFrame, keys: list[str], frame: str, slot: str, p: str, capacity: int, least: int, strong: int, weak: int, latest: float, silence: int) -> DataFrame:
    """The `capacity` rows that stay, slot by slot: keys, position, slot, frame. frame and slot are null for the silence row.

    Frames from `capacity` on are new and are raised by `latest`. `silence` rows a slot always stay; places without a scored frame
    hold the silence row, at the end.
    """
    s = frame_scores(probs, keys, frame, slot, p, least)
    s = s.withColumn("score", F.when(F.col(frame) >= capacity, F.round(F.col("score") + latest, 9)).otherwise(F.col("score")))
    half = 0.6931471805599453
    s = boost(boost(s, keys, frame, slot, strong, 2 * half), keys, frame, slot, weak, half).select(*keys, slot, frame, "score")
    rest = s.groupBy(*keys, slot).agg(F.explode(F.sequence(F.lit(1), F.lit(silence))).alias("_k")).select(*keys, slot, F.lit(None).cast(s.schema[frame].dataType).alias(frame), F.lit(float("inf")).alias("score")) if silence else s.limit(0)
    every = s.unionByName(rest)
    top = every.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc_nulls_last(), slot, F.col(frame).asc_nulls_last()))).filter(F.col("_n") <= capacity)
    top = top.withColumn("_gone", F.col("score").isNull())
    order = Window.partitionBy(*keys).orderBy("_gone", slot, F.col(frame).asc_nulls_last(), "_n")
    shown = lambda c: F.when(F.col("score") < float("inf"), F.col(c)).alias(c)
    return top.select(*keys, (F.row_number().over(order) - 1).alias("position"), shown(slot), shown(frame))
