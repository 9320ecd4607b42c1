"""Sharding by jump consistent hashing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The multiplier of the published generator (Lamping and Veach, 2014).
MULTIPLIER = 2862933555777941757
_LOW = (1 << 22) - 1
_C = (MULTIPLIER & _LOW, (MULTIPLIER >> 22) & _LOW, MULTIPLIER >> 44)


def key64(df: DataFrame, column: str) -> Column:
    """The key as 64 bits: whole numbers as they are, anything else hashed, null as 0."""
    kind = df.schema[column].dataType
    whole = isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType)
    return F.coalesce(F.col(column).cast("long"), F.lit(0).cast("long")) if whole else F.when(F.col(column).isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(column))


def jump(key: Column, shards: int) -> Column:
    """struct(shard, grown): the shard of a 64-bit key among `shards`, and among `shards + 1`.

    The generator needs products modulo 2**64, which SQL's long multiplication refuses, so its state is held
    in three limbs of 22, 22 and 20 bits. A row jumps from candidate to larger candidate; each jump goes up
    by one at least, so shards + 1 steps always suffice.
    """
    more = shards + 1
    long = lambda x: F.lit(x).cast("long")

    def step(acc: Column, _: Column) -> Column:
        p0 = acc.l0 * _C[0] + 1
        p1 = acc.l0 * _C[1] + acc.l1 * _C[0] + F.shiftright(p0, 22)
        p2 = acc.l0 * _C[2] + acc.l1 * _C[1] + acc.l2 * _C[0] + F.shiftright(p1, 22)
        l0, l1, l2 = p0.bitwiseAND(_LOW), p1.bitwiseAND(_LOW), p2.bitwiseAND((1 << 20) - 1)
        high = F.shiftleft(l2, 11) + F.shiftright(l1, 11)
        candidate = ((acc.j + 1) * (F.lit(float(1 << 31)) / (high + 1).cast("double"))).cast("long")
        moved = F.struct(candidate.alias("j"), F.when(acc.j < shards, acc.j).otherwise(acc.shard).alias("shard"), acc.j.alias("grown"), l0.alias("l0"), l1.alias("l1"), l2.alias("l2"))
        return F.when(acc.j >= more, acc).otherwise(moved)

    start = F.struct(
        long(0).alias("j"), long(0).alias("shard"), long(0).alias("grown"),
        key.bitwiseAND(_LOW).alias("l0"), F.shiftrightunsigned(key, 22).bitwiseAND(_LOW).alias("l1"), F.shiftrightunsigned(key, 44).alias("l2"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(more)), start, step)


#: Repetitions of one row that are numbered in one array.
RUN = 100_000


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24) -> DataFrame:
    """Put every row into one of `shards` shards by its key alone, and number the rows of a shard from 0.

    Columns: the key, size (UTF-8 bytes of the text plus 8), text_crc32, law ("key"), shard, slot and grown_shard (the shard
    if there were one more). Defined cases: a null key counts as key 0, a null text as no bytes (size 8, checksum 0);
    repeated rows share a shard and get slots of their own; an empty table gives an empty result; other columns of the table
    are left out. Rows that are equal in all of these are counted before the shuffle and written out again after it. A
    shard's different rows are numbered in 256 slices, by a hash of key, size and checksum, so no task orders a whole shard.
    """
    rows = df.select(
        F.col(key).alias("k"), key64(df, key).alias("bits"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
    ).withColumn("to", jump(F.col("bits"), shards))
    rows = rows.select("k", "bits", "size", "text_crc32", F.col("to.shard").cast("int").alias("shard"), F.col("to.grown").cast("int").alias("grown_shard"))
    each = rows.groupBy(*rows.columns).agg(F.count("*").alias("n"))
    slice_ = F.substring(F.md5(F.concat_ws("|", F.col("bits"), F.col("size"), F.col("text_crc32"))), 1, 2)
    each = each.withColumn("slice", slice_)
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = each.groupBy("shard", "slice").agg(F.sum("n").alias("of")).select("shard", "slice", F.coalesce(F.sum("of").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("shard", "slice").orderBy("bits", "size", "text_crc32", F.col("k").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    placed = each.withColumn("at", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, ["shard", "slice"]).withColumn("at", F.col("at") + F.col("start"))
    told = [F.col("k").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard"]
    few = placed.filter(F.col("n") <= RUN).select(*told, F.explode(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)).alias("slot"), "grown_shard")
    runs = placed.filter(F.col("n") > RUN).withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN)))).repartition("shard", "bits", "run")
    first = F.col("at") + F.col("run") * RUN
    many = runs.select(*told, F.explode(F.sequence(first, F.least(first + RUN, F.col("at") + F.col("n")) - 1)).alias("slot"), "grown_shard")
    return few.unionByName(many)
