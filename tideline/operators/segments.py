"""Segmentation: runs, hysteresis, regions, splices and levels."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _over(keys: list[str], order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order)


def hysteresis(frames: DataFrame, keys: list[str], frame: str, p: str, enter: float, leave: float, gap: int, least: int) -> DataFrame:
    """Intervals [start, end) of frames that are on: on above `enter`, off below `leave`, between them as before.

    Intervals at most `gap` frames apart become one, then those shorter than `least` frames go.
    """
    w = _over(keys, frame)
    decided = F.when(F.col(p) > enter, 1).when(F.col(p) < leave, 0)
    on = frames.select(*keys, frame, F.coalesce(F.last(decided, ignorenulls=True).over(w), F.lit(0)).alias("_on"))
    island = on.withColumn("_g", F.sum(F.when(F.col("_on") != F.coalesce(F.lag("_on").over(w), F.lit(0)), 1).otherwise(0)).over(w))
    runs = island.filter("_on = 1").groupBy(*keys, "_g").agg(F.min(frame).alias("start"), (F.max(frame) + 1).alias("end"))
    by_start = _over(keys, "start")
    joined = runs.withColumn("_h", F.sum(F.when(F.col("start") - F.lag("end").over(by_start) <= gap, 0).otherwise(1)).over(by_start))
    return joined.groupBy(*keys, "_h").agg(F.min("start").alias("start"), F.max("end").alias("end")).filter(F.col("end") - F.col("start") >= least).drop("_h")


def regions(frames: DataFrame, keys: list[str], frame: str, p: str, on: float, off: float, silence: int, speech: int, merge: int, pad: int) -> DataFrame:
    """Speech regions: begun at p >= on, ended by an off-frame (p < off) at least `silence` after the first one.

    Regions longer than `speech` stay; those under `merge` apart become one; those of at least `speech` stay and are
    padded, two neighbours sharing the space between them. Frames are numbered from 0 without gaps.
    """
    w = _over(keys, frame)
    size = frames.groupBy(*keys).agg((F.max(frame) + 1).alias("_n"))
    g = frames.withColumn("_g", F.sum(F.when(F.col(p) >= on, 1).otherwise(0)).over(w)).filter("_g > 0")
    is_off = F.col(p) < off
    spans = g.groupBy(*keys, "_g").agg(F.min(frame).alias("_first"), F.min(F.when(is_off, F.col(frame))).alias("_off"), F.max(F.when(is_off, F.col(frame))).alias("_last_off"))
    spans = spans.withColumn("_closes", F.coalesce(F.col("_last_off") - F.col("_off") >= silence, F.lit(False)))
    by_g = _over(keys, "_g")
    spans = spans.withColumn("_h", F.sum(F.when(F.coalesce(F.lag("_closes").over(by_g), F.lit(True)), 1).otherwise(0)).over(by_g))
    found = spans.groupBy(*keys, "_h").agg(F.min("_first").alias("s"), F.max(F.when(F.col("_closes"), F.col("_off"))).alias("e")).join(size, keys)
    found = found.withColumn("e", F.coalesce("e", "_n")).filter(F.col("e") - F.col("s") > speech)
    by_s = _over(keys, "s")
    found = found.withColumn("_m", F.sum(F.when(F.col("s") - F.lag("e").over(by_s) < merge, 0).otherwise(1)).over(by_s))
    found = found.groupBy(*keys, "_m", "_n").agg(F.min("s").alias("s"), F.max("e").alias("e")).filter(F.col("e") - F.col("s") >= speech)
    before, after = F.col("s") - F.lag("e").over(by_s), F.lead("s").over(by_s) - F.col("e")
    left = F.when(before < 2 * pad, F.floor(before / 2)).otherwise(pad)
    right = F.when(after < 2 * pad, F.floor(after / 2)).otherwise(pad)
    return found.select(*keys, F.greatest(F.col("s") - left, F.lit(0)).alias("start"), F.least(F.col("e") + right, F.col("_n")).alias("end"))


def moving_average(rows: DataFrame, keys: list[str], order: str, value: str, width: int = 5) -> DataFrame:
    return rows.withColumn("smoothed", F.avg(value).over(_over(keys, order).rowsBetween(1 - width, 0)))


def runs(rows: DataFrame, keys: list[str], order: str, label: Column) -> DataFrame:
    """Number the runs of equal labels within keys: adds run (from 1)."""
    w = _over(keys, order)
    new = F.when(label.eqNullSafe(F.lag(label).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("run", F.sum(new).over(w))


def blocks(rows: DataFrame, keys: list[str], order: str, label: str, start: str, end: str, text: str) -> DataFrame:
    """One row for each run: label, start of its first row, end of its last row (not the latest end), texts joined by a space."""
    numbered = runs(rows, keys, order, F.col(label))
    return numbered.groupBy(*keys, "run").agg(
        F.min_by(label, order).alias(label), F.min_by(start, order).alias("start"), F.max_by(end, order).alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), " ").alias("text"), F.count("*").alias("n"),
    )


def plain(text: str) -> Column:
    """A text in lower case with nothing but its letters and digits, of any script, and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", ""), r"\s+", " "))


def loops(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """Runs of equal texts that a decoder repeats: three or more of three words or more, or five or more of any that has one.

    Case, punctuation and spacing do not count; texts without letters and digits are all equal and repeat like any other.
    """
    numbered = runs(rows.withColumn("_p", plain(text)), keys, order, F.col("_p"))
    found = numbered.groupBy(*keys, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), F.min("_p").alias("plain"))
    return found.filter(((F.col("n") >= 3) & (F.size(F.split("plain", " ")) >= 3)) | (F.col("n") >= 5)).drop("run")


def collapsed_loops(rows: DataFrame, keys: list[str], order: str, start: str, end: str, text: str) -> DataFrame:
    """Rows with each loop (see loops) replaced by one: the first text, from its first start to its last end; repeats counts them."""
    numbered = runs(rows.withColumn("_p", plain(text)), keys, order, F.col("_p"))
    size = F.count("*").over(Window.partitionBy(*keys, "run"))
    looped = ((size >= 3) & (F.size(F.split("_p", " ")) >= 3)) | (size >= 5)
    numbered = numbered.withColumn("_of", F.when(looped, F.lit(None)).otherwise(F.col(order)))
    return numbered.groupBy(*keys, "run", "_of").agg(
        F.min(order).alias(order), F.min_by(text, order).alias(text), F.min_by(start, order).alias(start), F.max_by(end, order).alias(end), F.count("*").alias("repeats")
    ).drop("run", "_of")


def edges(rows: DataFrame, keys: list[str], order: str, active: Column) -> DataFrame:
    """Transitions of a boolean: edge is started or stopped; rows without one go."""
    was = F.coalesce(F.lag(active).over(_over(keys, order)), F.lit(False))
    return rows.withColumn("edge", F.when(active & ~was, "started").when(~active & was, "stopped")).filter("edge IS NOT NULL")


def grace_sessions(rows: DataFrame, keys: list[str], start: str, end: str, grace: float) -> DataFrame:
    """Active intervals less than `grace` apart are one session: session, start, end, n."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    latest = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = rows.withColumn("session", F.sum(F.when(F.col(start) - latest < grace, 0).otherwise(1)).over(w))
    return numbered.groupBy(*keys, "session").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n"))


def splice(regions_: DataFrame, keys: list[str], extend: float, gap: float, size: str | None = None) -> DataFrame:
    """A compact timeline of regions (start_s, end_s): each but the last lengthened by `extend` up to the next start, and put
    after each other with a gap. A piece starts where the one before it ends at the earliest, and ends with the track where
    `size` names a column with its length; pieces without length go. Adds piece_start_s, piece_end_s and spliced_s.

    Ends before a region are at most its start once lengthened, so the latest end of the regions before it bounds its start
    whether or not those before were kept whole.
    """
    w = Window.partitionBy(*keys).orderBy("start_s", "end_s")
    nxt = F.lead("start_s").over(w)
    end = F.when(nxt.isNull(), F.col("end_s")).otherwise(F.least(F.col("end_s") + extend, nxt))
    pieces = regions_.withColumn("piece_end_s", F.least(end, F.col(size)) if size else end)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("piece_start_s", F.greatest(F.col("start_s"), F.coalesce(F.max("piece_end_s").over(before), F.col("start_s")))).filter("piece_end_s > piece_start_s")
    return pieces.withColumn("spliced_s", F.coalesce(F.sum(F.col("piece_end_s") - F.col("piece_start_s") + gap).over(before), F.lit(0.0)))


def levels(rows: DataFrame, keys: list[str], order: str, value: str, audible: float, bridge: int) -> DataFrame:
    """peak, audible rows, and the longest stretch of audible rows with gaps of at most `bridge` between them."""
    loud = rows.filter(F.abs(value) > audible)
    w = _over(keys, order)
    islands = loud.withColumn("_g", F.sum(F.when(F.col(order) - F.lag(order).over(w) - 1 <= bridge, 0).otherwise(1)).over(w))
    longest = islands.groupBy(*keys, "_g").agg((F.max(order) - F.min(order) + 1).alias("_n")).groupBy(*keys).agg(F.max("_n").alias("longest"))
    all_ = rows.groupBy(*keys).agg(F.max(F.abs(value)).alias("peak"), F.count(F.when(F.abs(value) > audible, 1)).alias("audible"))
    return all_.join(longest, keys, "left").withColumn("longest", F.coalesce("longest", F.lit(0)))
