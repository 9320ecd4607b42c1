"""URL filters: dated list entries as validity intervals, joined to captures as of their fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import stored

#: The host of a URL with a scheme; a port, user and path are left out.
HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """Turn dated entries (list, kind, key, action, effective) into intervals in which a key is listed.

    action is "add" or "remove"; an entry holds until the next one of its list, kind and key. Of entries at one instant
    the removal wins. kind is "domain" (a host and all below it), "host" or "path" (host and path up to a "/").
    Entries with nulls are left out. Gives list, kind, key, from_ts (inclusive) and to_ts (exclusive, null: open).
    """
    given = entries.dropna(subset=["list", "kind", "key", "action", "effective"]).withColumn("key", F.lower("key"))
    at = given.groupBy("list", "kind", "key", "effective").agg(F.max(F.when(F.col("action") == "remove", 1).otherwise(0)).alias("gone"))
    later = Window.partitionBy("list", "kind", "key").orderBy("effective")
    return at.withColumn("to_ts", F.lead("effective").over(later)).filter("gone = 0").select("list", "kind", "key", F.col("effective").alias("from_ts"), "to_ts")


def depths(active: DataFrame, kind: str, mark: str) -> list[int]:
    """In how many labels or folders the list's keys of a kind come, as a driver-side list: a number for each such depth."""
    n = F.size(F.split(F.rtrim(F.col("key"), F.lit("/")), mark))
    return sorted(r["n"] for r in active.filter(F.col("kind") == kind).select(n.alias("n")).distinct().collect())


def lookups(url: Column, labels: list[int], folders: list[int]) -> Column:
    """Array of struct(kind, key): all entries that could match a URL. One for the host, one for each of its domains with so
    many labels as a listed one has, and one for each path prefix with so many folders; other prefixes are never built."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    label = F.split(host, "\\.")
    path = F.lower(F.regexp_extract(url, PATH, 1))
    part = F.split(path, "/")
    ends = lambda n: F.when(F.size(label) >= n, F.array_join(F.slice(label, F.size(label) - n + 1, n), "."))
    starts = lambda n: F.when(F.size(part) > n, F.concat(host, F.array_join(F.slice(part, 1, n), "/"), F.lit("/")))
    keys = [("host", host), *(("domain", ends(n)) for n in labels), *(("path", starts(n)) for n in folders)]
    every = F.filter(F.array(*[F.struct(F.lit(kind).alias("kind"), key.alias("key")) for kind, key in keys]), lambda x: x["key"].isNotNull())
    return F.when(host != "", every).otherwise(F.filter(every, lambda x: F.lit(False)))


def evaluate(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """For each capture: n_active (entries that match it and were active when it was fetched), blocked, and the deciding entry.

    The deciding entry is the longest key, of equals the smallest kind and list. Columns: key, fetched, n_active, blocked,
    list, kind, entry. The join is on (kind, key), so a hot host is a hot key of a plain equi-join, which Spark splits.
    Defined cases: a null URL, one without host, and a null fetch time match nothing (n_active 0); repeated rows count
    once for each row; a URL of any length costs what the list's depths need; empty tables give empty or unblocked results; other columns are left out.
    """
    rows = captures.select(F.col(key), F.col(fetched), F.col(url).alias("_url"))
    active = stored(intervals(entries), "url-intervals")
    asked = rows.select(key, fetched, "_url").distinct().withColumn("_x", F.explode(lookups(F.col("_url"), depths(active, "domain", "\\."), depths(active, "path", "/"))))
    asked = asked.select(F.col(key).alias("_k"), F.col(fetched).alias("_f"), F.col("_url").alias("_u"), F.col("_x.kind").alias("_kind"), F.col("_x.key").alias("_key"))
    hit = asked.join(active, (asked["_kind"] == active["kind"]) & (asked["_key"] == active["key"]) & (asked["_f"] >= active["from_ts"]) & (active["to_ts"].isNull() | (asked["_f"] < active["to_ts"])))
    best = F.min(F.struct((-F.length("_key")).alias("n"), F.col("kind"), F.col("list"), F.col("_key").alias("entry")))
    found = hit.groupBy("_k", "_f", "_u").agg(F.count("*").alias("_n"), best.alias("_best"))
    same = rows[key].eqNullSafe(found["_k"]) & rows[fetched].eqNullSafe(found["_f"]) & rows["_url"].eqNullSafe(found["_u"])
    n = F.coalesce(F.col("_n"), F.lit(0)).cast("long")
    return rows.join(found, same, "left").select(key, fetched, n.alias("n_active"), (n > 0).alias("blocked"), F.col("_best.list").alias("list"), F.col("_best.kind").alias("kind"), F.col("_best.entry").alias("entry"))
