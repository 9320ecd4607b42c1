"""Plans over a timeline: merged tracks, windows and spans, positions mapped back, lags, stalls and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import stats
from tideline.operators.lineage import checkpointed


def track_offsets(mic_ticks: Column, speaker_ticks: Column, numer: Column, denom: Column) -> tuple[Column, Column]:
    """Seconds by which the microphone's and the speaker's track start later; one of them is 0. Ticks become whole nanoseconds."""
    ticks = (mic_ticks - speaker_ticks) * numer
    left = ticks % denom  # has the sign of ticks, so the quotient is cut towards 0
    ns = F.when(denom == 0, F.raise_error(F.lit("a timebase with denominator 0"))).otherwise((ticks - left) / denom)
    return F.greatest(ns / 1e9, F.lit(0.0)), F.greatest(-ns / 1e9, F.lit(0.0))


def merge_tracks(mic: DataFrame, speaker: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both tracks (keys, order, start_s, end_s, offset_s, ...) in one: shifted by their offsets and numbered by start; the microphone first where equal."""
    both = mic.withColumn("track", F.lit("mic")).unionByName(speaker.withColumn("track", F.lit("speaker")))
    both = both.withColumn("start_s", F.col("start_s") + F.col("offset_s")).withColumn("end_s", F.col("end_s") + F.col("offset_s")).drop("offset_s")
    return both.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("start_s", "track", order)))


def map_back(pieces: DataFrame, positions: DataFrame, keys: list[str], pos: str = "pos", end: str | None = None, least: float = 0.01) -> DataFrame:
    """Where a position of a spliced timeline lies in the original one: original_s.

    The first piece whose end lies after the position holds it; a position in a gap becomes that piece's start, one after
    all pieces the end of the last. pieces: keys, piece_start_s, piece_end_s, spliced_s. Each position meets one piece only.
    Where `end` names the end of a stretch that begins at the position, original_end_s is its end in the piece that holds the
    position, and `least` after original_s at the earliest.
    """
    w = Window.partitionBy(*keys).orderBy("_at")
    to = F.col("spliced_s") + F.col("piece_end_s") - F.col("piece_start_s")
    p = pieces.select(*keys, F.col("piece_start_s").alias("_s"), F.col("piece_end_s").alias("_e"), F.col("spliced_s").alias("_at"), to.alias("_to"))
    p = p.withColumn("_from", F.coalesce(F.lag("_to").over(w), F.lit(float("-inf")))).withColumn("_last", F.lead("_to").over(w).isNull())
    other = p.select(*[F.col(k).alias(f"_{k}") for k in keys], "_s", "_e", "_at", "_to", "_from", "_last")
    held = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(pos) >= F.col("_from"), (F.col(pos) < F.col("_to")) | F.col("_last")]
    start = F.least(F.col("_s") + F.greatest(F.col(pos) - F.col("_at"), F.lit(0.0)), F.col("_e"))
    out = positions.join(other, held).select(*positions.columns, start.alias("original_s"), "_s", "_e", "_at")
    if end:
        out = out.withColumn("original_end_s", F.greatest(F.least(F.col("_s") + F.col(end) - F.col("_at"), F.col("_e")), F.col("original_s") + least))
    return out.drop("_s", "_e", "_at")


def window_plan(tracks: DataFrame, size: str, window: int, stride: int) -> DataFrame:
    """The starts of windows that cover each track (window_start): every stride, and the last one aligned with the end. A shorter track has one window."""
    last = F.greatest(F.col(size) - window, F.lit(0)).cast("long")
    starts = F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), last, F.lit(stride).cast("long")), F.array(last))))
    return tracks.filter(F.col(size) > 0).withColumn("window_start", F.explode(starts))


#: Pieces that a span's start is compared with at once, when the next span's start is looked for.
AHEAD = 16


def _same(left: str, right: str, keys: list[str]) -> Column:
    """All keys agree between two aliased tables, null with null."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def next_starts(pieces: DataFrame, keys: list[str], gap: int, most: int) -> DataFrame:
    """keys, n and to: where the next span starts if one starts at piece n; no row where none follows. pieces: keys, n, low, high.

    What follows a start depends on the start alone. Each start looks at its next AHEAD pieces; those that found no end of
    their span there look further, round by round, until none is left. Only that is asked of the driver.
    """
    here = pieces.select(*keys, "n", F.col("low").alias("s"), F.col("high").alias("e"), F.col("n").alias("last"))
    found = None
    while True:
        ahead = here.withColumn("j", F.explode(F.sequence(F.col("last") + 1, F.col("last") + AHEAD))).alias("h")
        met = ahead.join(pieces.alias("p"), _same("h", "p", keys) & (F.col("h.j") == F.col("p.n"))).select("h.*", "low", "high")
        before = F.greatest("e", F.coalesce(F.max("high").over(Window.partitionBy(*keys, "n").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)), F.col("e")))
        joins = (F.col("low") < before + gap) & (F.greatest(before, F.col("high")) - F.col("s") <= most)
        seen = met.withColumn("joins", joins).groupBy(*keys, "n", "s", "e", "last").agg(F.min(F.when(~F.col("joins"), F.col("j"))).alias("to"), F.count("*").alias("c"), F.max("high").alias("m"))
        seen = checkpointed(seen.filter(F.col("to").isNotNull() | (F.col("c") == AHEAD)))
        some = seen.filter("to IS NOT NULL").select(*keys, "n", "to")
        found = some if found is None else found.unionByName(some)
        here = seen.filter("to IS NULL").select(*keys, "n", "s", F.greatest("e", "m").alias("e"), (F.col("last") + AHEAD).alias("last"))
        if here.isEmpty():
            return checkpointed(found)


def reached(jumps: DataFrame, keys: list[str], first: DataFrame) -> DataFrame:
    """keys and n of what is reached from `first` (keys, n) by any number of jumps (keys, n, to; a later n each).

    Pointer doubling: round k adds what 2 ** k jumps reach from all that is known, so rounds grow with the logarithm of the
    longest chain.
    """
    known, jump = first, jumps
    while True:
        more = checkpointed(known.alias("k").join(jump.alias("j"), _same("k", "j", keys) & (F.col("k.n") == F.col("j.n"))).select(*[F.col(f"k.{k}").alias(k) for k in keys], F.col("to").alias("n")))
        if more.isEmpty():
            return known
        known = checkpointed(known.unionByName(more))
        jump = checkpointed(jump.alias("a").join(jump.alias("b"), _same("a", "b", keys) & (F.col("a.to") == F.col("b.n"))).select(*[F.col(f"a.{k}").alias(k) for k in keys], "a.n", "b.to"))


def span_plan(regions: DataFrame, keys: list[str], context: int, gap: int, most: int) -> DataFrame:
    """Spans to work on, with what they own: keys, span, start, end, piece_start, piece_end, fade_in, fade_out.

    regions: keys, start, end, size (the track's length), in whole samples. A region is cut into pieces of at most `most` less
    twice the context. In the order of start and end, a piece with its context joins the span before it if it begins less than
    `gap` after its end and the two together hold at most `most`. Regions without length own nothing; equal regions own
    twice; null keys are a track; an empty table gives an empty result.
    """
    own = max(most - 2 * context, 1)
    cut = regions.filter(F.col("end") > F.col("start")).withColumn("piece_start", F.explode(F.sequence(F.col("start").cast("long"), F.col("end").cast("long") - 1, F.lit(own).cast("long"))))
    cut = cut.withColumn("piece_end", F.least(F.col("piece_start") + own, F.col("end").cast("long")))
    order = Window.partitionBy(*keys).orderBy("start", "end", "piece_start", "size")
    pieces = checkpointed(cut.select(
        *keys, F.row_number().over(order).cast("long").alias("n"), F.greatest(F.col("piece_start") - context, F.lit(0)).alias("low"), F.least(F.col("piece_end") + context, F.col("size").cast("long")).alias("high"),
        "piece_start", "piece_end", (F.col("piece_start") == F.col("start")).alias("fade_in"), (F.col("piece_end") == F.col("end")).alias("fade_out"),
    ))
    starts = reached(next_starts(pieces.select(*keys, "n", "low", "high"), keys, gap, most), keys, pieces.filter("n = 1").select(*keys, "n"))
    marked = pieces.alias("p").join(starts.withColumn("_first", F.lit(1)).alias("s"), _same("p", "s", keys) & (F.col("p.n") == F.col("s.n")), "left").select("p.*", "_first")
    spans = marked.withColumn("span", F.count("_first").over(Window.partitionBy(*keys).orderBy("n")) - 1)
    whole = Window.partitionBy(*keys, "span")
    return spans.select(*keys, "span", F.min_by("low", "n").over(whole).alias("start"), F.max("high").over(whole).alias("end"), "piece_start", "piece_end", "fade_in", "fade_out")


def loud_windows(candidates: DataFrame, keys: list[str], apart: int, most: int = 12) -> DataFrame:
    """Up to `most` windows of each track, by falling energy (ties: earlier), each at least `apart` from all chosen before:
    keys and start. candidates: keys, start, energy.

    Rounds: every candidate that none beats within its distance is taken, as nothing can come before it that is near, and its
    neighbours go. A track's best candidate left is taken in each round, so after `most` rounds the `most` best of all taken are
    those that the walk takes. Stretches of `apart` samples hold one such candidate at most and meet only their neighbours, so a
    track is worked on in as many parts as it has stretches. Energy that is null, NaN or not above zero is silence; equal
    candidates count once; null keys are a track; an empty table gives an empty result.
    """
    stretch = lambda at: F.floor(F.col(at) / apart)
    left = candidates.filter((F.col("energy") > 0) & ~F.isnan(F.col("energy").cast("double"))).select(*keys, F.col("start").cast("long").alias("start"), "energy").distinct()
    left, taken = checkpointed(left.withColumn("part", stretch("start"))), None
    near = lambda df: df.withColumn("part", F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)))
    meets = _same("x", "y", keys) & (F.col("x.part") == F.col("y.part")) & (F.abs(F.col("x.start") - F.col("y.start")) < apart)
    for _ in range(most):
        best = left.groupBy(*keys, "part").agg(F.max(F.struct("energy", (-F.col("start")).alias("_s"))).alias("b")).select(*keys, "part", (-F.col("b._s")).alias("start"), F.col("b.energy").alias("energy"))
        better = (F.col("y.energy") > F.col("x.energy")) | ((F.col("y.energy") == F.col("x.energy")) & (F.col("y.start") < F.col("x.start")))
        beaten = near(best).alias("x").join(left.alias("y"), meets & better, "left_semi").select(*keys, F.col("start")).distinct()
        won = checkpointed(best.alias("x").join(beaten.alias("y"), _same("x", "y", keys) & (F.col("x.start") == F.col("y.start")), "left_anti"))
        taken = won if taken is None else taken.unionByName(won)
        left = checkpointed(left.alias("x").join(near(won).alias("y"), meets, "left_anti"))
        if left.isEmpty():
            break
    if taken is None:
        return left.select(*keys, "start").limit(0)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("energy").desc(), "start"))
    return taken.withColumn("_n", rank).filter(F.col("_n") <= most).select(*keys, "start")


def steady_lags(lags: DataFrame, keys: list[str], at: str, lag: str, tolerance: int, spread: int, least: int = 3) -> DataFrame:
    """One lag for each track from the lags of its windows: keys, result, lag, windows, spread, slope.

    A robust line goes through the windows; those further from it than four times the median deviation (`tolerance` at least)
    go. result: measured (lag at the middle of the time left), too_few_windows or inconsistent_windows (over `spread` apart).
    """
    middle = lambda df, c, name: df.join(stats.upper_medians(df, keys, c).withColumnRenamed("upper", name), keys)
    fit = checkpointed(stats.repeated_median(lags, keys, at, lag))  # met by each of the medians below
    counted = lags.groupBy(*keys).agg(F.count("*").alias("_n"))
    p = lags.join(fit, keys).join(counted, keys).withColumn("_r", F.col(lag) - F.round(F.col("intercept") + F.col("slope") * F.col(at)))
    p = middle(middle(p, "_r", "_c").withColumn("_d", F.abs(F.col("_r") - F.col("_c"))), "_d", "_m")
    kept = (F.col("_d") <= F.greatest(4 * F.col("_m"), F.lit(tolerance))) & (F.col("_n") >= least)
    p = lags.select(*keys).distinct().join(p.withColumn("_k", F.coalesce(kept, F.lit(False))), keys, "left").withColumn("_k", F.coalesce("_k", F.lit(False)))
    some = lambda c: F.when(F.col("_k"), c)
    g = p.groupBy(*keys).agg(
        F.count_if("_k").alias("windows"), (F.max(some(F.col("_r"))) - F.min(some(F.col("_r")))).cast("long").alias("spread"), F.first("slope").alias("slope"),
        F.first("intercept").alias("_i"), F.min(some(F.col(at))).alias("_a"), F.max(some(F.col(at))).alias("_b"),
    )
    result = F.when(F.col("windows") < least, "too_few_windows").when(F.col("spread") > spread, "inconsistent_windows").otherwise("measured")
    there = F.round(F.col("_i") + F.col("slope") * (F.col("_a") + (F.col("_b") - F.col("_a")) / 2)).cast("long")
    return g.withColumn("result", result).select(*keys, "result", F.when(F.col("result") == "measured", there).alias("lag"), "windows", "spread", F.when(F.col("result") == "measured", F.col("slope")).alias("slope"))


def stalls(buffers: DataFrame, keys: list[str], at: str, order: str, limit: Column) -> DataFrame:
    """Buffers that came more than `limit` after the one before: adds waited. The first buffer of a track is never late."""
    return buffers.withColumn("waited", F.col(at) - F.lag(at).over(Window.partitionBy(*keys).orderBy(at, order))).filter(F.col("waited") > limit)


def device_changes(rows: DataFrame, keys: list[str], order: str, device: str) -> DataFrame:
    """Rows whose device differs from the row before or was lost; a device that appears is no change."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("was", F.lag(device).over(w)).filter(F.col("was").isNotNull() & ~F.col("was").eqNullSafe(F.col(device)))


def timing_profile(buffers: DataFrame, keys: list[str], at: str, order: str, frames: str, period: float) -> DataFrame:
    """Gaps between buffers (first, upper median, least, most) and the largest drift from the time that their frames should take."""
    w = Window.partitionBy(*keys).orderBy(at, order)
    before = F.coalesce(F.sum(frames).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    b = buffers.withColumn("_gap", F.col(at) - F.lag(at).over(w)).withColumn("_n", F.row_number().over(w)).withColumn("_drift", F.col(at) - F.min(at).over(Window.partitionBy(*keys)) - before * period)
    middle = stats.upper_medians(b, keys, "_gap").withColumnRenamed("upper", "median_gap")
    return b.groupBy(*keys).agg(
        F.max(F.when(F.col("_n") == 2, F.col("_gap"))).alias("first_gap"), F.min("_gap").alias("least_gap"),
        F.max("_gap").alias("most_gap"), F.max(F.abs("_drift")).alias("most_drift"), F.count("*").alias("n"),
    ).join(middle, keys, "left")


def batch_selection(sessions: DataFrame, requested: DataFrame | None, again: bool = False) -> DataFrame:
    """What a batch does with each session (session, state): selected, missing, orphaned or done already. No request means all."""
    state = F.col("state")
    status = F.when(state.isNull(), "missing").when(state == "orphaned", "orphaned").when((state == "transcribed") & F.lit(not again), "done").otherwise("selected")
    asked = sessions if requested is None else requested.select("session").distinct().join(sessions, "session", "left")
    return asked.select("session", status.alias("status"))
