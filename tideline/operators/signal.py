"""Samples and frames as rows: fades, peaks of a correlation, noise floors, gains, panning and mixing."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import stats


def faded(samples: DataFrame, pieces: DataFrame, keys: list[str], fade: int) -> DataFrame:
    """Samples (keys, i, plain, isolated) with the isolated ones blended in over pieces (keys, piece_start, piece_end, fade_in, fade_out; apart from
    each other): value. A ramp is `fade` samples long, half the piece (rounded up) at most; a sample that has no isolated value
    stays as it is, and so do those outside all pieces. Pieces meet samples by the last piece that starts before them.
    """
    p = pieces.select(*keys, F.col("piece_start").alias("i"), F.struct("piece_start", "piece_end", "fade_in", "fade_out").alias("_p"))
    line = samples.select(*keys, "i", "plain", "isolated", F.lit(None).cast(p.schema["_p"].dataType).alias("_p"))
    line = line.unionByName(p.select(*keys, "i", F.lit(None).cast(samples.schema["plain"].dataType).alias("plain"), F.lit(None).cast(samples.schema["isolated"].dataType).alias("isolated"), "_p"))
    w = Window.partitionBy(*keys).orderBy("i", F.col("_p").isNull())
    held = line.withColumn("_h", F.last("_p", ignorenulls=True).over(w)).filter("_p IS NULL")
    size = F.col("_h.piece_end") - F.col("_h.piece_start")
    ramp = F.least(F.lit(fade), F.ceil(size / 2)).cast("double")
    into = F.when(F.col("_h.fade_in"), (F.col("i") - F.col("_h.piece_start")) / ramp).otherwise(1.0)
    out = F.when(F.col("_h.fade_out"), (F.col("_h.piece_end") - F.col("i")) / ramp).otherwise(1.0)
    blended = F.col("plain") + F.least(into, out, F.lit(1.0)) * (F.col("isolated") - F.col("plain"))
    inside = F.col("_h").isNotNull() & (F.col("i") < F.col("_h.piece_end")) & F.col("isolated").isNotNull()
    return held.select(*keys, "i", F.when(inside, blended).otherwise(F.col("plain")).alias("value"))


def correlation_peaks(values: DataFrame, keys: list[str], at: str, value: str, edge: int, exclusion: int, ratio: float) -> DataFrame:
    """The peak of each key's values: keys, peak_at, or no row where it proves nothing.

    The greatest value counts, the last of equals. It has to be above 0, at least `edge` away from both ends, and `ratio` times
    the root mean square of all values more than `exclusion` away from it.
    """
    top = values.groupBy(*keys).agg(F.max(F.struct(F.col(value).alias("v"), F.col(at).alias("i"))).alias("_t"), F.min(at).alias("_a"), F.max(at).alias("_z"))
    away = values.join(top, keys).filter(F.abs(F.col(at) - F.col("_t.i")) > exclusion)
    rms = away.groupBy(*keys).agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("_r"))
    sound = (F.col("_t.v") > 0) & (F.col("_t.i") >= F.col("_a") + edge) & (F.col("_t.i") <= F.col("_z") - edge) & (F.col("_r") > 0) & (F.col("_t.v") / F.col("_r") >= ratio)
    return top.join(rms, keys).filter(sound).select(*keys, F.col("_t.i").alias("peak_at"))


def noise_floor(samples: DataFrame, keys: list[str], at: str, value: str, block: int) -> DataFrame:
    """The upper median of the levels (root mean square) of blocks of samples, the last of which may be shorter: keys, floor."""
    levels = samples.groupBy(*keys, F.floor(F.col(at) / block).alias("_b")).agg(F.sqrt(F.avg(F.col(value).cast("double") * F.col(value))).alias("_l"))
    return stats.upper_medians(levels, keys, "_l").withColumnRenamed("upper", "floor")


def sampled_median(frames: DataFrame, keys: list[str], at: str, value: str, every: int = 100) -> DataFrame:
    """The upper median of every `every`th frame's value: keys, median."""
    return stats.upper_medians(frames.filter(F.col(at) % every == 0), keys, value).withColumnRenamed("upper", "median")


def energies(samples: DataFrame, keys: list[str], at: str, value: str, window: int, stride: int | None = None) -> DataFrame:
    """The energy of each window of so many samples that is whole: keys, start, energy. Windows start every `stride` samples
    from 0 on, a quarter of a window unless said otherwise.

    Samples are summed in blocks first, and blocks in windows, so a track is not one task's work. A null value has no energy
    but is there; a sample given twice counts twice; an empty table gives an empty result.
    """
    step = stride or max(1, window // 4)
    block = math.gcd(window, step)
    blocks = samples.groupBy(*keys, F.floor(F.col(at) / block).alias("_b")).agg(F.coalesce(F.sum(F.col(value).cast("double") * F.col(value)), F.lit(0.0)).alias("_e"), F.count("*").alias("_n"))
    low, high = F.ceil((F.col("_b") * block + block - window) / step), F.floor(F.col("_b") * block / step)
    spread = blocks.filter(high >= F.greatest(low, F.lit(0))).withColumn("start", F.explode(F.sequence(F.greatest(low, F.lit(0)) * step, high * step, F.lit(step).cast("long"))))
    e = spread.groupBy(*keys, "start").agg(F.sum("_e").alias("energy"), F.sum("_n").alias("_n"))
    return e.filter(F.col("_n") == window).select(*keys, "start", "energy")


def dbfs(peak: Column) -> Column:
    """A peak in decibels of full scale; null for digital silence."""
    return F.when(peak > 0, 20 * F.log10(peak))


def gain(lufs: Column, target: float, most: float) -> Column:
    """The factor that brings a loudness to the target, raising it by `most` decibels at most; 1 without a loudness."""
    return F.coalesce(F.pow(F.lit(10.0), F.least(F.lit(target) - lufs, F.lit(most)) / 20), F.lit(1.0))


def constant_power(pan: Column) -> tuple[Column, Column]:
    """Left and right factor of a source at pan (-1 left to 1 right); their squares sum to one."""
    theta = (F.greatest(F.lit(-1.0), F.least(F.lit(1.0), pan)) + 1) * (math.pi / 4)
    return F.cos(theta), F.sin(theta)


def mixed_down(samples: DataFrame, sources: DataFrame, keys: list[str], rate: int, ceiling: float = 0.99) -> DataFrame:
    """Sources of a track set (keys, source, i, value) in one stereo track: sources gives source, offset_s, gain and pan.

    Keys, i, left, right. A mix whose greatest sample exceeds the ceiling is scaled down to it as a whole.
    """
    left, right = constant_power(F.col("pan"))
    s = sources.select(*keys, "source", F.floor(F.greatest("offset_s", F.lit(0.0)) * rate + 0.5).cast("long").alias("_from"), (F.col("gain") * left).alias("_l"), (F.col("gain") * right).alias("_r"))
    put = samples.join(s, [*keys, "source"]).groupBy(*keys, (F.col("i") + F.col("_from")).alias("i")).agg(F.sum(F.col("value") * F.col("_l")).alias("left"), F.sum(F.col("value") * F.col("_r")).alias("right"))
    peak = put.groupBy(*keys).agg(F.max(F.greatest(F.abs("left"), F.abs("right"))).alias("_peak"))
    scale = F.when(F.col("_peak") > ceiling, ceiling / F.col("_peak")).otherwise(1.0)
    return put.join(peak, keys).select(*keys, "i", (F.col("left") * scale).alias("left"), (F.col("right") * scale).alias("right"))
