"""Quality rules: a text's own figures, and lines that recur across the documents of a host."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import discard, given_back, mix, pieces, prepare, stored

_SPACES = b" \t\n\r\x0b\x0c"
_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Limits:
    """A line goes if more than max(most_docs, most_share of the host's documents) different documents of its host
    have it; a document is depleted if under least_left of its words stay. base_*: the text's own limits."""

    most_docs: int = 50
    most_share: float = 0.01
    least_left: float = 0.3
    base_words: int = 20
    base_repeat: int = 30


def repeat_words(words: list[bytes], width: int = 8) -> int:
    """Words that lie in a window of `width` words which the text holds twice or more, the first included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    ids = mix(ids + np.uint64(1))
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n]
    _, which, count = np.unique(h, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[which] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def line_hash(line: bytes) -> int:
    """Of the line in lower-case ASCII with its white space squeezed, as a signed long."""
    return int.from_bytes(hashlib.blake2b(b" ".join(line.lower().split()), digest_size=8).digest(), "little", signed=True)


def whole_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def figures(text: str) -> tuple[int, int, int, int, int, list[tuple[int, int]]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and (hash, words) of each line with a word."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    solid = data.translate(None, _SPACES)
    chars = len(solid) - int(((np.frombuffer(solid, np.uint8) & 0xC0) == 0x80).sum())
    seen: set[bytes] = set()
    dup, lines = 0, []
    for line in data.split(b"\n"):
        if n := len(line.split()):
            dup += line in seen
            seen.add(line)
            lines.append((line_hash(line), n))
    return len(words), chars, len(data) - len(data.translate(None, _SYMBOLS)), dup, repeat_words(words), lines


def measure(docs: DataFrame, text: str = "text", host: str = "source", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, host, the five figures, a digest of the whole text and lines (array of hash and words)."""
    prepare(docs.sparkSession)
    rows = docs.select(*keep, F.col(host).cast("string").alias("host"), F.col(text).alias("_text"))
    schema = rows.drop("_text").schema
    for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
        schema = schema.add(name, "long")
    schema = schema.add("digest", "long").add("lines", T.ArrayType(T.StructType().add("h", "long").add("w", "long")))
    line = pa.list_(pa.struct([("h", pa.int64()), ("w", pa.int64())]))

    def each(batches):
        for batch in batches:
            for piece in pieces(batch, "_text"):
                columns: list[list] = [[] for _ in range(7)]
                for value in piece.column("_text"):
                    text_ = value.as_py() or ""
                    *numbers, lines = figures(text_)
                    for column, x in zip(columns, [*numbers, whole_hash(text_), [{"h": h, "w": w} for h, w in lines]], strict=True):
                        column.append(x)
                kinds = [pa.int64()] * 6 + [line]
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in [*keep, "host"]), *map(pa.array, columns, kinds)], names=schema.names)

    return rows.mapInArrow(given_back(each), schema)


def line_limits(measured: DataFrame, limits: Limits) -> DataFrame:
    """host and line of the lines above their host's limit.

    A line counts once for each different whole text of its host that has it; exact copies count once. Near copies are different
    texts: what more of them than the limit share is boilerplate. Only lines in enough rows of a host are counted
    by texts, so that few lines move. Null hosts are one host.
    """
    hosts = measured.groupBy("host").agg(F.greatest(F.lit(float(limits.most_docs)), F.count("*") * F.lit(limits.most_share)).alias("_most")).withColumnRenamed("host", "_host")
    above = lambda counted: counted.join(hosts, counted["host"].eqNullSafe(hosts["_host"])).filter(F.col("docs") > F.col("_most")).select(F.col("host").alias("_host"), F.col("h").alias("_h"))
    each = measured.select("host", "digest", F.explode(F.array_distinct(F.transform("lines", lambda x: x.h))).alias("h"))
    some = stored(above(each.groupBy("host", "h").agg(F.count("*").alias("docs")).filter(F.col("docs") > limits.most_docs)), "quality-some")
    different = each.join(some, each["host"].eqNullSafe(some["_host"]) & (each["h"] == some["_h"])).select("host", "h", "digest").distinct()
    return above(different.groupBy("host", "h").agg(F.count("*").alias("docs")))


def judge(measured: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The measured rows (a stored table with a column _row that numbers them) with n_left, base_failed and kept."""
    over = stored(line_limits(measured, limits), "quality-lines")
    lines = measured.select("_row", "host", F.explode("lines").alias("x"))
    gone = lines.join(over, lines["host"].eqNullSafe(over["_host"]) & (F.col("x.h") == over["_h"])).groupBy("_row").agg(F.sum("x.w").alias("_gone"))
    failed = (F.col("n_words") < limits.base_words) | (100 * F.col("n_repeat_words") > limits.base_repeat * F.col("n_words"))
    return (
        measured.drop("lines", "digest").join(gone, "_row", "left").withColumn("n_left", F.col("n_words") - F.coalesce(F.col("_gone"), F.lit(0)))
        .withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("n_left") >= limits.least_left * F.col("n_words"))).drop("_gone")
    )


def quality_table(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row for each document: doc_id, the figures, n_left, base_failed and kept.

    Defined cases: a null or empty text has no words and fails; a null source is a host of its own; repeated rows are
    judged alike; a null doc_id is carried through; an empty table gives an empty result; other columns are left out.
    """
    measured = stored(measure(docs).withColumn("_row", F.monotonically_increasing_id()), "quality")
    return judge(measured, limits).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_left", "base_failed", "kept")


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs that the rules keep, with all columns, whatever their names. A row is found again by source and whole
    text, so rows that are equal in both share a verdict, as they do in quality_table(), whose defined cases hold here too."""
    text, source = F.coalesce(F.col("text"), F.lit("")), F.col("source").cast("string")
    digest = F.sha2(F.concat(F.when(source.isNull(), "0").otherwise(F.concat(F.lit("1"), source)), F.lit("|"), text), 256)
    keyed = docs.select(F.struct("*").alias("row"), digest.alias("key"), source.alias("source"), text.alias("text"))
    measured = stored(measure(keyed, keep=("key",)).withColumn("_row", F.monotonically_increasing_id()), "quality")
    bad = stored(judge(measured, limits).filter("NOT kept").select(F.col("key").alias("bad")).distinct(), "quality-bad")
    discard(measured)
    return keyed.join(bad, F.col("key") == F.col("bad"), "left_anti").select("row.*")
