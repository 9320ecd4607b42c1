"""The corpus pipeline: language ID, quality rules, near duplicates, mixing, encoding; each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bpe, language, mixing, neardup, quality
from tideline.llm.common import stored
from tideline.llm.queries import TOKENIZER

#: A document goes if no language is recognised, or the recognised one holds a smaller share of its n-grams than this.
LEAST_SCORE = 0.2
#: Near duplicates: shingles of five words, similarity 0.8 or more.
NEAR = neardup.Likeness(words=5, num=80, den=100)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without a recognisable language. Rows are found again by their whole text, which alone decides.

    Null and empty texts, and texts without letters, have no language and go; rows of equal text share a verdict; without any
    labelled text no language is known and every row goes; an empty table gives an empty result; all columns stay, of any name.
    """
    filters = language.learn(language.training_rows(docs))
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.struct("*").alias("row"), text.alias("text"), F.sha2(text, 256).alias("key"))
    judged = language.predict(keyed, filters, keep=("key",))
    bad = stored(judged.filter((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SCORE)).select(F.col("key").alias("bad")).distinct(), "language-bad")
    return keyed.join(bad, F.col("key") == F.col("bad"), "left_anti").select("row.*")


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that fail the rules on their own figures, or that the lines common to their source deplete.

    Null and empty texts have no words and go; a null source is one source; rows equal in source and text share a verdict; an
    empty table gives an empty result; all columns stay, of any name.
    """
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, that with the smallest id; see keep_one for nulls, ties and repeated rows."""
    return neardup.keep_one(docs, NEAR)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks; see mix_table for nulls, ties and repeated rows."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document with digests of ids and decoded text; a null text counts as empty, and every row gives one."""
    return bpe.encode_table(docs, TOKENIZER, keep=("doc_id", "lang", "source"), ids=True)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("near_duplicates", drop_near_duplicates),
    ("source_mixing", mix_sources),
    ("bpe_encoding", encode),
]

#: Language filters, backtracking encoding and link components are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
