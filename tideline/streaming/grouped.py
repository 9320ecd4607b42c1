"""Small keys whose state is held by groups of keys."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

#: Groups of a stream whose keys were not counted, the fewest of one whose keys were, and the keys of a group then.
GROUPS, FEWEST, KEYS = 1024, 64, 500


def in_groups(stream: DataFrame, key: str, groups: int) -> GroupedData:
    """The stream by a hash of its key. Keyed state costs Spark some ten messages between its process and Python's for each key
    and batch; a group of keys costs as many. A checkpoint belongs to one number of groups."""
    return stream.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(groups))).groupBy("_group")


def names(column: pd.Series) -> list[str | None]:
    """Strings as Python holds them; a null is None, whatever pandas makes of it."""
    return [x if isinstance(x, str) else None for x in column]


def groups_for(rows: DataFrame, key: str) -> int:
    """A power of two that leaves about KEYS keys to a group, so that groups grow in number with the keys and not in size."""
    keys = rows.agg(F.approx_count_distinct(key)).first()[0]
    return max(FEWEST, 1 << math.ceil(math.log2(max(1, keys / KEYS))))
