"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import n_words, stored, unit_hash

#: Weights that repeat over the sources in code point order, null last.
WEIGHTS = (3, 1, 2)
#: Rows equal in id, source and text that one task numbers at a time; more of them are dealt to several tasks.
PIECE = 1 << 16
#: Words to share out, as a part of all words; and the most a source may get, as a multiple of its own.
SHARE, MOST = 1.5, 2.0


def source_sizes(docs: DataFrame, source: str = "source", size: Column | None = None) -> DataFrame:
    """One row for each source, null included: source, source_size."""
    size = n_words(F.col("text")) if size is None else size
    return docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))


def cyclic_weights(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Add column weight: the weights in turn, over sources in code point order, null last."""
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))


def targets(weighted: DataFrame, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Share out `share` of all words by weight; a source stops at `most` times its own size, and what it leaves goes to the rest.

    Takes source, source_size, weight (above 0); adds target and rate (target over size; 0 for a source without words).
    Sources in order of cap over weight fill up first, so one pass over one row for each source finds the level at
    which the others stand. The windows without partitions hold one row for each source, never documents.
    """
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    level = (F.col("_total") - F.coalesce(F.col("_filled"), F.lit(0.0))) / F.col("_left")
    return (
        weighted.withColumn("_cap", F.col("source_size") * F.lit(most)).withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_total", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("_filled", F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_first", F.min(F.when(level < F.col("_ratio"), F.struct(F.col("_ratio"), F.col("source").isNull(), F.col("source"), level.alias("level")))).over(everything))
        .withColumn("target", F.coalesce(F.least(F.col("_cap"), F.col("_first.level") * F.col("weight")), F.col("_cap")))
        .withColumn("rate", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)))
        .select("source", "source_size", "weight", "target", "rate")
    )


def numbered(classes: DataFrame) -> DataFrame:
    """Every row of classes (with n, how many equal rows one stands for) n times, with column number from 1 to n in place of n.

    Classes of more than PIECE rows are cut into pieces that go to tasks of their own, so no task writes out a hot class.
    """
    few = classes.filter(F.col("n") <= PIECE).withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    piece = classes.filter(F.col("n") > PIECE).withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"), F.lit(PIECE).cast("long")))).repartition("doc_id", "digest", "first")
    many = piece.withColumn("number", F.explode(F.sequence(F.col("first"), F.least(F.col("n"), F.col("first") + PIECE - 1)))).drop("first")
    return few.unionByName(many).drop("n")


def mixed(rows: DataFrame, rates: DataFrame, seed: int = 17) -> DataFrame:
    """Adds source_size, target and copies to rows (source, doc_id, digest of the text, and others of other names): floor(rate)
    copies, and one more with probability the rate's fraction, drawn from a hash of seed, doc_id, digest and, where rows have
    a number above 1 among their equals, of that number.

    Reruns draw alike, rows without an id draw by their texts, and equal rows without numbers draw alike. The rates are stored
    first, so Spark sees their size and broadcasts them only under its own limit; beyond it the join is by shuffle, split
    where a source is hot.
    """
    known = stored(rates, "mix-rates").select(F.col("source").alias("of"), "source_size", "target", "rate")
    digest = F.when(F.col("number") > 1, F.concat_ws("|", "digest", "number")).otherwise(F.col("digest")) if "number" in rows.columns else F.col("digest")
    draw = (unit_hash(F.lit(seed), F.col("doc_id"), digest) < F.col("rate") - F.floor("rate")).cast("int")
    return rows.join(known, rows["source"].eqNullSafe(known["of"]), "left").withColumn("copies", (F.floor("rate") + draw).cast("int"))


def _digest(text: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest")


def mix_table(docs: DataFrame, seed: int = 17) -> DataFrame:
    """Every document with its size, its source's size and target, and the words that the mix takes of it.

    Defined cases: a null source is a source of its own, last in order; a null or empty text has size 0 and takes 0;
    rows equal in id, source and text are counted, numbered and draw each for itself, so a source of one repeated document
    meets its target too; an empty table gives an empty result; further columns are left out.
    """
    sized = docs.select("doc_id", "source", _digest(), n_words(F.col("text")).alias("size"))
    classes = stored(sized.groupBy("doc_id", "source", "digest", "size").agg(F.count("*").alias("n")), "mix-classes")
    rates = targets(cyclic_weights(source_sizes(classes, size=F.col("size") * F.col("n"))))
    return mixed(numbered(classes), rates, seed).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The mix itself: every document as often as drawn, with all its columns, whatever their names.

    Defined cases are those of mix_table, but rows equal in id and text draw alike here; a source whose rate is 0 (without words) gives no rows.
    """
    rates = targets(cyclic_weights(source_sizes(docs)))
    rows = docs.select(F.struct("*").alias("row"), "source", "doc_id", _digest())
    drawn = mixed(rows, rates, seed).filter("copies > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
