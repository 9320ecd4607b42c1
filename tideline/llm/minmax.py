"""Near duplicates by min-max hashing.

Each permutation of a set's shingles is evaluated once and gives two values, the smallest and the largest. Both agree
between two sets with a probability of their Jaccard similarity, and they fail together less often than two values of
separate permutations do, so bands of minima and bands of maxima take half the hash evaluations of bands of minima alone, and
miss no more. Classes of equal sets that share a band meet; links are confirmed on whole sets.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import neardup
from tideline.llm.common import discard, mix, stored
from tideline.llm.neardup import CELLS, Likeness

#: Values of a band.
ROWS = 6
#: Shingles of two words, similarity 0.8 or more.
LIKE = Likeness(words=2, num=80, den=100)


@lru_cache(maxsize=16)
def bands(like: Likeness, rows: int = ROWS) -> int:
    """Bands of `rows` values, an even number of them: sets at the threshold share none with a probability of `miss` or less."""
    return 2 * math.ceil(math.log(like.miss) / math.log1p(-((like.num / like.den) ** rows)) / 2)


def signature(tokens: np.ndarray, permutations: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest and the largest value of a set under each of several permutations of 32-bit numbers."""
    first, second = neardup.seeds(permutations)
    plain = (tokens >> np.uint64(32)).astype(np.uint32)
    step = max(1, CELLS // len(plain))
    least, most = np.empty(permutations, np.uint32), np.empty(permutations, np.uint32)
    for i in range(0, permutations, step):
        h = plain * first[i : i + step]
        h ^= h >> np.uint32(15)
        h *= second[i : i + step]
        least[i : i + step], most[i : i + step] = h.min(axis=1), h.max(axis=1)
    return least, most


def band_names(tokens: np.ndarray, like: Likeness, rows: int = ROWS) -> np.ndarray:
    """A name for each band of a set: first the bands of minima, then those of maxima."""
    if not len(tokens):
        return np.zeros(0, np.uint64)
    half = bands(like, rows) // 2
    both = np.concatenate(signature(tokens, half * rows)).astype(np.uint64)
    each = mix(both + (np.arange(len(both), dtype=np.uint64) << np.uint64(32)))
    return mix(each.reshape(2 * half, rows).sum(axis=1, dtype=np.uint64))


def link_components(docs: DataFrame, like: Likeness = LIKE) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows (stored), and component_id of each node (stored): classes that share a band ask its leader, and
    what a band holds beside is settled by the rarest tokens of whole sets, see neardup.settled()."""
    rows = stored(neardup.sketches(docs, like, band_names), "minmax-rows")
    classes = rows.filter("node IS NOT NULL")
    unique = classes.select("node", "hints").dropDuplicates(["node"])
    several = stored(neardup.meeting(unique.select("node", F.explode("hints").alias("block"))), "minmax-bands")
    owners = stored(neardup.owners_of(classes).join(several.select("node").distinct(), "node"), "minmax-owners")
    sets = stored(neardup.token_sets(docs, owners, like), "minmax-sets")
    discard(owners)
    return rows, neardup.settled(classes, sets, several, like)


def dedup_table(docs: DataFrame, like: Likeness = LIKE) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) and kept (it is the document's own) of each row.

    Two linked sets share no band with a probability of like.miss or less; every link is confirmed on whole sets. Defined cases:
    a text without words, or null, has no shingles, is its own component and stays; documents with equal sets are linked; rows
    that repeat an id and its text share their verdict, and of rows with other texts each is a document of its own; a row
    without doc_id links as any other and stays only where its whole component has no id; an empty table gives an empty
    result; other columns are left out.
    """
    found = neardup.rows_with_components(docs, like, link_components)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
