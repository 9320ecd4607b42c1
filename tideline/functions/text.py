"""Time labels, names and cues as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types


def mmss(seconds: Column) -> Column:
    """Whole seconds as MM:SS; minutes go on beyond 99."""
    s = F.floor(F.greatest(seconds, F.lit(0)))
    return F.format_string("%02d:%02d", F.floor(s / 60), s % 60)


def parse_mmss(label: Column) -> Column:
    """Seconds of a label such as 12:34 or [12:34]; null for anything else."""
    inner = F.regexp_extract(F.trim(label), r"^(?:\[([0-9]+:[0-5][0-9])\]|([0-9]+:[0-5][0-9]))$", 0)
    plain = F.regexp_replace(inner, r"[\[\]]", "")
    return F.when(inner != "", F.split_part(plain, F.lit(":"), F.lit(1)).cast("long") * 60 + F.split_part(plain, F.lit(":"), F.lit(2)).cast("long"))


def vtt_time(seconds: Column) -> Column:
    ms = F.round(F.greatest(seconds, F.lit(0.0)) * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def vtt_end(start: Column, end: Column) -> Column:
    """A cue ends a millisecond after its start at least."""
    return vtt_time(F.greatest(F.round(end * 1000), F.round(start * 1000) + 1) / 1000)


def cue_text(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(text, r"[\r\n]+", " ")


def folded(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))


def edit_budget(name: Column) -> Column:
    """How many edits still count as a near miss."""
    n = F.char_length(name)
    return F.when(n < 4, 0).when(n < 8, 1).otherwise(2)


def without_characters(name: Column, most: int) -> Column:
    """A name and what is left of it without any one (or two, for most=2) of its characters; distinct."""
    drop = lambda x: F.when(F.char_length(x) > 0, F.transform(F.sequence(F.lit(1), F.char_length(x)), lambda i: F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1)))).otherwise(F.array().cast("array<string>"))
    out = F.array(name)
    for _ in range(most):
        out = F.array_distinct(F.concat(out, F.flatten(F.transform(out, drop))))
    return out


def prefixes(word: Column) -> Column:
    """All prefixes of a word, itself included."""
    return F.when(F.char_length(word) > 0, F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.substr(word, F.lit(1), i))).otherwise(F.array().cast("array<string>"))


@F.pandas_udf(types.IntegerType())
def osa_distance(a, b):  # noqa: ANN001
    """Edits between two names where two neighbours that changed places count once (optimal string alignment)."""
    import pandas as pd

    def one(x: str, y: str) -> int:
        two, last = None, list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            row = [i]
            for j, d in enumerate(y, 1):
                best = min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d))
                if i > 1 and j > 1 and c == y[j - 2] and x[i - 2] == d:
                    best = min(best, two[j - 2] + 1)
                row.append(best)
            two, last = last, row
        return last[-1]

    return pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def human_duration(seconds: Column) -> Column:
    s = F.floor(F.greatest(seconds, F.lit(0)))
    return F.when(s < 60, F.format_string("%ds", s)).otherwise(F.format_string("%dm %02ds", F.floor(s / 60), s % 60))


def mail_address(link: Column) -> Column:
    return F.nullif(F.regexp_extract(link, "(?i)^mailto:(.+)$", 1), F.lit(""))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")


def yaml_scalar(text: Column) -> Column:
    """A text as a quoted JSON string, which YAML reads as the same text; null stays null as the word null."""
    return F.when(text.isNull(), "null").otherwise(F.regexp_extract(F.to_json(F.struct(text.alias("t"))), r'^\{"t":(.*)\}$', 1))


def audio_span(millis: Column) -> Column:
    """A span of audio for people: tenths of seconds under a minute, h:mm:ss from there on."""
    tenths, s = F.floor(millis / 100), F.floor(millis / 1000)
    return F.when(millis < 60_000, F.format_string("%d.%01d s", F.floor(tenths / 10), tenths % 10)).otherwise(F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60))


def ticks_to_millis(ticks: Column, numer: Column, denom: Column) -> Column:
    return ticks.cast("double") * numer / denom / 1e6


def percent(done: Column, total: Column) -> Column:
    """Whole percent, 100 at most; 0 of nothing."""
    whole = F.floor(done.cast("decimal(38,0)") * 100 / F.nullif(total, F.lit(0)))
    return F.least(F.coalesce(whole, F.lit(0)), F.lit(100)).cast("long")


def elapsed(seconds: Column) -> Column:
    """47s or 4m07s."""
    s = F.floor(seconds).cast("long")
    return F.when(s >= 60, F.format_string("%dm%02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))


def sample_at(seconds: Column, rate: int, rounded: bool = True) -> Column:
    """The sample of an instant, by rounding to the nearest one or by cutting off; not before 0."""
    at = F.greatest(seconds, F.lit(0.0)) * rate
    return (F.floor(at + 0.5) if rounded else F.floor(at)).cast("long")


def trimmed(text: Column) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def spoken(seconds: Column) -> Column:
    """Seconds of speech as read in a question: 37s, or 3m 25s."""
    whole = F.round(seconds).cast("long")
    return F.when(whole < 60, F.format_string("%ds", whole)).otherwise(F.format_string("%dm %02ds", F.floor(whole / 60), whole % 60))


def hundredths(x: Column) -> Column:
    """A number with two decimals, six places wide, rounded as C and Rust print it: by the number's exact binary value, a tie
    to the even digit. format_string rounds the shortest decimals that stand for it instead, so 0.295 would read 0.30."""
    v = F.abs(x.cast("double"))
    n = F.rint(v * 200)
    high = v * 134217729.0 - (v * 134217729.0 - v)  # the upper half of its bits, so that the products are exact
    beside = (high * 200 - n) + (v - high) * 200
    odd = F.when(beside < 0, n - 1).when(beside > 0, n + 1).otherwise(n + 1 - (n + 1) % 4)
    whole = F.when(v < 1e9, F.when(n % 2 == 0, n).otherwise(odd) / 200).otherwise(v)
    return F.format_string("%6.2f", F.when(x < 0, -whole).otherwise(whole))
