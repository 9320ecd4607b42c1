"""The queries opN_<name> over whole tables, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bpe, language, licenses, minmax, mixing, neardup, nearest, periods, quality, sharding, trie, urlfilter, warc

#: Where the tokenizer file is.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

#: Dated entries of the URL lists that op3 applies (list, kind, key, action, effective).
URL_ENTRIES = (
    ("ads", "domain", "example.net", "add", "2024-01-02 00:00:00"),
    ("ads", "domain", "example.net", "remove", "2024-01-05 00:00:00"),
    ("ads", "host", "tionsh.example.net", "add", "2024-01-03 12:00:00"),
    ("ads", "host", "m.thther.example.org", "add", "2024-01-01 06:00:00"),
    ("ads", "host", "m.thther.example.org", "remove", "2024-01-01 18:00:00"),
    ("ads", "host", "m.thther.example.org", "add", "2024-01-04 00:00:00"),
    ("malware", "domain", "tionble.example.com", "add", "2024-01-01 00:00:00"),
    ("malware", "path", "ththon.example.com/en/", "add", "2024-01-02 00:00:00"),
    ("malware", "path", "tionsh.example.net/fr/", "add", "2024-01-01 00:00:00"),
    ("malware", "path", "tionsh.example.net/fr/", "remove", "2024-01-08 00:00:00"),
    ("adult", "domain", "example.org", "add", "2024-01-20 00:00:00"),
)
#: Pages carry no fetch time; page n counts as fetched n minutes after this instant.
FETCHED_FROM = "2024-01-01 00:00:00"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join_table(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_table(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.timestamp_micros(F.unix_micros(F.lit(FETCHED_FROM).cast("timestamp")) + F.col("page_id") * 60_000_000).alias("fetched_at"))
    entries = spark.createDataFrame(URL_ENTRIES, "list string, kind string, key string, action string, at string").select("list", "kind", "key", "action", F.col("at").cast("timestamp").alias("effective"))
    return urlfilter.evaluate(pages, entries).select("page_id", "n_active", "blocked", "list", "kind", "entry")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(_table(spark, sf_dir, "documents"))


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record is rebuilt from header and payload, and the columns are read off the rebuilt record."""
    path = warc.write_archive(_table(spark, sf_dir, "pages"))
    return warc.rebuilt(warc.read_archive(spark, path, bodies="records"))


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_table(_table(spark, sf_dir, "documents"), TOKENIZER)


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_known", F.array_join("licenses", ",").alias("licenses"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(_table(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents carry no URL; a document's source counts as its host."""
    return quality.quality_table(_table(spark, sf_dir, "documents"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.runs_digest(_table(spark, sf_dir, "documents"))


def op13_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minmax.dedup_table(_table(spark, sf_dir, "documents"))


def queries():
    named = (op1_ngram_jaccard_join, op2_language_id, op3_url_filter, op4_source_mixing, op5_warc_archive, op6_bpe_codec, op7_license_scan, op8_nearest_neighbours, op9_sharding, op10_quality_rules, op11_conversation_trie, op12_period_runs, op13_minmax_dedup)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    from tideline.llm import oracle

    return oracle.sql(URL_ENTRIES, FETCHED_FROM)
