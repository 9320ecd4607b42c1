"""Evaluation: spreads, error rates, intervals and robust fits."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spread(rows: DataFrame, keys: list[str], value: str, width: float = 0.001) -> DataFrame:
    """count, min, p05, median (mean of the middle two), p95 (both by nearest rank), max and mean; of keys without values a row of
    nulls.

    Rows become one for each value with its count, values stretches of `width`. Running sums go over the stretches, whose number
    the range of values bounds, and within each stretch over its own values, so no task reads all values of a key.
    """
    by = rows.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(value).alias("_n"), F.sum(value).alias("_s"))
    by = by.withColumn("_w", F.floor(F.col("_v") / width))
    sums = by.groupBy(*keys, "_w").agg(F.sum("_n").alias("_wn"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.sum("_s").alias("_ws"))
    sums = sums.withColumn("_before", F.sum("_wn").over(Window.partitionBy(*keys).orderBy("_w")) - F.col("_wn")).withColumn("_all", F.sum("_wn").over(Window.partitionBy(*keys)))
    whole = sums.groupBy(*keys).agg(F.sum("_wn").alias("n"), F.min("_least").alias("least"), F.max("_most").alias("most"), (F.sum("_ws") / F.nullif(F.sum("_wn"), F.lit(0))).alias("mean"))
    ranks = {"p05": F.greatest(F.ceil(0.05 * F.col("_all")), F.lit(1)), "low": F.floor((F.col("_all") + 1) / 2), "high": F.floor(F.col("_all") / 2) + 1, "p95": F.greatest(F.ceil(0.95 * F.col("_all")), F.lit(1))}
    upto = F.col("_before") + F.col("_wn")
    asked = sums.filter("_w IS NOT NULL").filter(F.exists(F.array(*ranks.values()), lambda r: (r > F.col("_before")) & (r <= upto)))
    same = [F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in keys] + [F.col("_w") == F.col("_kw")]
    inside = by.join(F.broadcast(asked.select(*[F.col(k).alias(f"_k{k}") for k in keys], F.col("_w").alias("_kw"), "_before", "_all")), same)
    to = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_w").orderBy("_v"))
    inside = inside.withColumn("_to", to)
    at = lambda name: F.max(F.when((ranks[name] <= F.col("_to")) & (ranks[name] > F.col("_to") - F.col("_n")), F.col("_v"))).alias(name)
    found = inside.groupBy(*[F.col(k).alias(f"_k{k}") for k in keys]).agg(*map(at, ranks))
    out = whole.join(found, [F.col(k).eqNullSafe(F.col(f"_k{k}")) for k in keys], "left")
    return out.select(*keys, "n", "least", "p05", ((F.col("low") + F.col("high")) / 2).alias("median"), "p95", "most", "mean")


def error_rates(trials: DataFrame, cut: float, same: str = "same", distance: str = "distance") -> DataFrame:
    """One row: false accepts (different under the cut) and false rejects (same at or over it), with rates; null without trials."""
    s, d = F.col(same), F.col(distance)
    return trials.agg(
        F.count_if(~s).alias("n_different"), F.count_if(~s & (d < cut)).alias("false_accepts"), F.count_if(s).alias("n_same"), F.count_if(s & (d >= cut)).alias("false_rejects"),
        F.min(F.when(~s, d)).alias("zero_accept_cut"), F.max(F.when(s, d)).alias("most_same"),
    ).withColumn("accept_rate", F.try_divide("false_accepts", "n_different")).withColumn("reject_rate", F.try_divide("false_rejects", "n_same"))


def equal_error(trials: DataFrame, same: str = "same", distance: str = "distance", width: float = 0.001) -> DataFrame:
    """The cut among the distances at which the two error rates differ least (ties: smaller mean rate, smaller cut).

    Trials become one row for each distance, distances stretches of `width`. Running sums go over the stretches, whose number
    the range of distances bounds, and within each stretch over its own distances.
    """
    by = trials.groupBy(F.col(distance).alias("cut")).agg(F.count_if(F.col(same)).alias("s"), F.count_if(~F.col(same)).alias("x"))
    by = by.withColumn("_w", F.floor(F.col("cut") / width))
    before = Window.orderBy("_w").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = by.groupBy("_w").agg(F.sum("s").alias("ws"), F.sum("x").alias("wx"))
    sums = sums.select("_w", F.coalesce(F.sum("ws").over(before), F.lit(0)).alias("bs"), F.coalesce(F.sum("wx").over(before), F.lit(0)).alias("bx"), F.sum("ws").over(every).alias("ns"), F.sum("wx").over(every).alias("nx"))
    below = Window.partitionBy("_w").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    rates = by.withColumn("_s", F.coalesce(F.sum("s").over(below), F.lit(0))).withColumn("_x", F.coalesce(F.sum("x").over(below), F.lit(0))).join(sums, "_w")
    rates = rates.withColumn("accept", F.try_divide(F.col("_x") + F.col("bx"), F.col("nx"))).withColumn("reject", F.try_divide(F.col("ns") - F.col("_s") - F.col("bs"), F.col("ns")))
    best = rates.agg(F.min(F.struct(F.abs(F.col("accept") - F.col("reject")).alias("gap"), ((F.col("accept") + F.col("reject")) / 2).alias("rate"), F.col("cut"))).alias("b"))
    return best.select(F.col("b.cut").alias("cut"), F.col("b.rate").alias("rate"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """95 % interval of a share; exact at both ends, null without cases or with more hits than cases."""
    p, ok = k / F.nullif(n, F.lit(0)), (n > 0) & (k <= n) & (k >= 0)
    mid, half, scale = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)), 1 + z * z / n
    return F.when(ok, F.when(k == 0, 0.0).otherwise((mid - half) / scale)), F.when(ok, F.when(k == n, 1.0).otherwise((mid + half) / scale))


def upper_medians(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The upper of the two middle values of each key's values that aren't null: keys, upper. Equal values are one row with
    their count, and running sums over these find the middle, so no group is held in one row."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("upper")).agg(F.count("*").alias("_n"))
    up_to = F.sum("_n").over(Window.partitionBy(*keys).orderBy("upper"))
    all_ = F.sum("_n").over(Window.partitionBy(*keys))
    middle = counted.withColumn("_to", up_to).withColumn("_half", F.floor(all_ / 2)).filter("_to > _half AND _to - _n <= _half")
    return middle.select(*keys, "upper")


#: Slopes that a task holds at a time.
SLOPES = 1 << 20


def _upper(values, counts):  # noqa: ANN001, ANN202
    """For each row of values the upper of the two middle ones, each counted so often (none: NaN)."""
    import numpy as np

    order = np.argsort(np.where(counts > 0, values, np.nan), axis=1, kind="stable")
    order = np.take_along_axis(order, np.argsort(np.take_along_axis(counts == 0, order, axis=1), axis=1, kind="stable"), axis=1)
    upto = np.take_along_axis(counts, order, axis=1).cumsum(axis=1)
    at = (upto > upto[:, -1:] // 2).argmax(axis=1)
    return np.where(upto[:, -1] > 0, np.take_along_axis(values, np.take_along_axis(order, at[:, None], axis=1), axis=1)[:, 0], np.nan)


def repeated_median(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """slope and intercept by upper medians: of each point's slopes to the others, then of those. A key's points are the
    windows of a track and one row; a point meets the others there, so a task holds a track's windows and some of their
    slopes, and pairs are no rows. Points of one x have no slope to each other. A key whose points all share an x has no row."""
    p = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.count("*").alias("_c"))
    tracks = p.groupBy(*keys).agg(F.collect_list(F.struct("_x", "_y", "_c")).alias("_p")).select(*keys, F.col("_p._x").alias("_x"), F.col("_p._y").alias("_y"), F.col("_p._c").alias("_c"))

    def line(x, y, c):  # noqa: ANN001, ANN202
        import numpy as np

        each, step = [], max(1, SLOPES // len(x))
        for i in range(0, len(x), step):
            run, rise = x[None, :] - x[i : i + step, None], y[None, :] - y[i : i + step, None]
            apart = run != 0
            each.append(_upper(np.divide(rise, run, out=np.zeros_like(run), where=apart), np.where(apart, c[None, :], 0)))
        sloped = np.where((x != x[0]).any(), c, 0)  # where any two differ, each point has another beside it
        slope = _upper(np.concatenate(each)[None, :], sloped[None, :])[0]
        return (slope, _upper((y - slope * x)[None, :], c[None, :])[0]) if sloped.any() else None

    def lines(batches):  # noqa: ANN001, ANN202
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            at = {name: batch.column(name) for name in ("_x", "_y", "_c")}
            found = [line(*(column[i].values.to_numpy(zero_copy_only=False) for column in at.values())) for i in range(batch.num_rows)]
            some = np.flatnonzero([f is not None for f in found])
            told = [pa.array([found[i][j] for i in some], pa.float64()) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*batch.select(keys).take(pa.array(some, pa.int64())).columns, *told], [*keys, "slope", "intercept"])

    return tracks.mapInArrow(lines, tracks.select(*keys).schema.add("slope", "double").add("intercept", "double"))


def gated_loudness(steps: DataFrame, keys: list[str], order: str, energy: str, absolute: float = -70.0, relative: float = 10.0) -> DataFrame:
    """Integrated loudness of step energies: blocks of four steps, an absolute gate, then one `relative` below their mean."""
    w = Window.partitionBy(*keys).orderBy(order)
    loud = lambda e: -0.691 + 10 * F.log10(e)
    blocks = steps.withColumn("_e", F.avg(energy).over(w.rowsBetween(-3, 0))).withColumn("_n", F.row_number().over(w)).filter("_n >= 4 AND _e > 0")
    first = blocks.filter(loud(F.col("_e")) > absolute)
    gate = first.groupBy(*keys).agg((loud(F.avg("_e")) - relative).alias("_gate"))
    return first.join(gate, keys).filter(loud(F.col("_e")) > F.col("_gate")).groupBy(*keys).agg(loud(F.avg("_e")).alias("lufs"), F.count("*").alias("n_blocks"))
