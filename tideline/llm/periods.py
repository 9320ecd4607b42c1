"""Runs of words that repeat with a period, found by refining classes of equal factors.

E(p) puts positions with equal factors of p words into one class. E(p + 1) follows from E(p): a class is split by the classes of
the positions after its own, and of the pieces that a class was split into the largest need not be looked at. Where
neighbouring members of a class of E(p) lie p apart, a square of period p begins; squares at consecutive positions make a run. All
texts of a batch are refined at once, level by level, on arrays.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import gathered, pieces, prepare

#: A run has so many words at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text that are refined at once.
TEXT_BYTES = 8 << 20


def spans(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each span, one after the other."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - count), count)


def in_order(keys: tuple[np.ndarray, ...], n: int) -> tuple[np.ndarray, ...]:
    """The rows of columns with values below n, sorted by them in turn; packed into one number where they fit."""
    bits = max(1, int(n).bit_length())
    if bits * len(keys) <= 63:
        packed = keys[0].astype(np.int64)
        for k in keys[1:]:
            packed = (packed << bits) | k
        packed.sort()
        out = []
        for _ in keys:
            out.append(packed & ((1 << bits) - 1))
            packed = packed >> bits
        return tuple(reversed(out))
    order = np.lexsort(keys[::-1])
    return tuple(k[order] for k in keys)


class Partition:
    """Classes of positions 0 .. n - 1: each class is a stretch of `members`, its positions linked in order.

    A link to the next member holds from level `since` on. When it goes, and at the end, it is a square if it held at the
    level that equals its length.
    """

    def __init__(self, letters: np.ndarray, most: np.ndarray) -> None:
        """letters: positions of one number are of one class at level 1; most: the longest period wanted at each position."""
        n = len(letters)
        self.n, self.most, self.level = n, most, 1
        self.members = np.argsort(letters, kind="stable")
        sorted_ = letters[self.members]
        first = np.flatnonzero(np.diff(sorted_, prepend=sorted_[0] - 1)) if n else np.zeros(0, np.int64)
        self.start, self.size = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
        self.classes = len(first)
        self.start[: len(first)], self.size[: len(first)] = first, np.diff(first, append=n)
        self.of, self.place = np.empty(n, np.int64), np.empty(n, np.int64)
        self.of[self.members] = np.repeat(np.arange(len(first)), self.size[: len(first)])
        self.place[self.members] = np.arange(n)
        self.next, self.before = np.full(n, -1), np.full(n, -1)
        together = np.flatnonzero(np.diff(sorted_) == 0)
        self.next[self.members[together]] = self.members[together + 1]
        self.before[self.members[together + 1]] = self.members[together]
        self.since = np.ones(n, np.int64)
        self.moving = np.zeros(n, bool)
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def _ended(self, at: np.ndarray, last: int | np.ndarray) -> None:
        """Take the squares among the links of these positions, which held up to level `last`."""
        gap = self.next[at] - at
        good = (gap >= self.since[at]) & (gap <= last) & (gap <= self.most[at])
        if good.any():
            self.found.append((gap[good], at[good]))

    def _relink(self, at: np.ndarray, to: np.ndarray) -> None:
        changed = self.next[at] != to
        at, to = at[changed], to[changed]
        self._ended(at, self.level)
        self.next[at], self.since[at] = to, self.level + 1

    def refine(self, at: np.ndarray) -> np.ndarray:
        """Go to the next level, split by the positions `at` of the last level's smaller pieces; gives the next such positions."""
        ahead, at = self.of[at], at - 1
        keep = at >= 0
        keep &= (self.size[self.of[at]] > 1) & (self.most[at] > self.level)
        ahead, at = ahead[keep], at[keep]
        if not len(at):
            self.level += 1
            return at
        cls, ahead, at = in_order((self.of[at], ahead, at), self.n)
        group = np.flatnonzero((np.diff(cls, prepend=-1) != 0) | (np.diff(ahead, prepend=-1) != 0))
        count = np.diff(group, append=len(at))
        of_group = cls[group]
        edge = np.flatnonzero(np.diff(of_group, prepend=-1))  # first group of each class
        touched, moved = of_group[edge], np.add.reduceat(count, edge)
        rest = self.size[touched] - moved
        groups_of = np.diff(edge, append=len(group))
        largest = np.maximum.reduceat(count, edge)
        which = np.repeat(np.arange(len(edge)), groups_of)
        top = np.flatnonzero(count == largest[which])
        top = top[np.diff(which[top], prepend=-1) != 0]  # the first largest group of each class
        stays, smaller = np.zeros(len(group), bool), np.ones(len(group), bool)
        stays[top[rest == 0]] = True  # nothing else is left of the class: this group keeps its number
        smaller[top[(rest == 0) | (largest > rest)]] = False
        rest_is_smaller = (rest > 0) & (largest > rest)

        go = ~stays
        if not go.any():
            self.level += 1
            return at[:0]
        taken = np.repeat(go, count)
        at, cls, count, of_group, smaller = at[taken], cls[taken], count[go], of_group[go], smaller[go]
        group = np.cumsum(count) - count

        # links of those that stay pass over those that go
        self.moving[at] = True
        by_place = in_order((cls, at), self.n)[1]
        opens = self.before[by_place] != np.concatenate(([-2], by_place[:-1]))
        closes = self.next[by_place] != np.concatenate((by_place[1:], [-2]))
        left, right = self.before[by_place[opens]], self.next[by_place[closes]]
        has_left, has_right = left >= 0, right >= 0
        self._relink(left[has_left], right[has_left])
        self.before[right[has_right]] = left[has_right]
        # those that go are linked within their groups
        after, prior = np.concatenate((at[1:], [-1])), np.concatenate(([-1], at[:-1]))
        after[np.append(group[1:], len(at)) - 1] = -1
        prior[group] = -1
        self._relink(at, after)
        self.before[at] = prior

        # they take the end of their class's stretch
        edge = np.flatnonzero(np.diff(cls, prepend=-1))
        lost, from_ = np.diff(edge, append=len(at)), cls[edge]
        tail = self.start[from_] + self.size[from_] - lost
        target = spans(tail, lost)
        place = self.place[at]
        free = place[place < np.repeat(tail, lost)]
        held = self.members[target]
        held = held[~self.moving[held]]
        self.members[free], self.place[held] = held, free
        self.members[target], self.place[at] = at, target
        self.moving[at] = False
        new = self.classes + np.arange(len(count))
        self.classes += len(count)
        self.start[new], self.size[new] = target[group], count
        self.size[from_] -= lost
        self.of[at] = np.repeat(new, count)
        self.level += 1
        left_over = touched[rest_is_smaller]
        return np.concatenate((at[np.repeat(smaller, count)], self.members[spans(self.start[left_over], self.size[left_over])]))

    def squares(self) -> tuple[np.ndarray, np.ndarray]:
        """Periods and positions of all squares with a primitive root whose period is wanted, in order."""
        at = np.arange(self.n)
        while len(at):
            at = self.refine(at)
        linked = np.flatnonzero(self.next >= 0)
        self._ended(linked, np.iinfo(np.int64).max)
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return in_order((np.concatenate([g for g, _ in self.found]), np.concatenate([a for _, a in self.found])), self.n)


def runs(texts: list[list[bytes]], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """For each text its runs as (start, length, period), by start, then period.

    A run is a stretch with smallest period q, of at least max(least_words, least_periods * q) words, that no neighbouring word
    extends; least_periods is 2 or more.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    offset = np.cumsum(sizes + 1) - (sizes + 1)  # a letter of its own ends each text
    n = int((sizes + 1).sum())
    letters, most = np.empty(n, np.int64), np.zeros(n, np.int64)
    known = 0
    for words, start in zip(texts, offset.tolist(), strict=True):
        number: dict[bytes, int] = {}
        letters[start : start + len(words)] = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words)) + known
        known += len(number) + 1
        letters[start + len(words)] = known - 1
        most[start : start + len(words)] = len(words) // least_periods
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    period, at = Partition(letters, most).squares()
    if not len(at):
        return out
    first = np.flatnonzero((np.diff(period, prepend=-1) != 0) | (np.diff(at, prepend=-2) != 1))
    last = np.append(first[1:], len(at)) - 1
    start, period = at[first], period[first]
    length = at[last] - start + 2 * period
    good = length >= np.maximum(least_words, least_periods * period)
    start, length, period = start[good], length[good], period[good]
    owner = np.searchsorted(offset, start, "right") - 1
    for i in np.lexsort((period, start)):
        out[owner[i]].append((int(start[i] - offset[owner[i]]), int(length[i]), int(period[i])))
    return out


def planted(words: list[bytes], key: int | None) -> list[bytes]:
    """The words, or, for every tenth key, words whose end repeats a stretch of them; where and how often follows from the key."""
    n = len(words)
    if key is None or not n or (h := zlib.crc32(str(key).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def longest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length / period; of equal ones that with the smallest start, then period."""
    best = None
    for run in found:  # in the order of start and period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def runs_table(docs: DataFrame, repeat_some: bool = False) -> DataFrame:
    """doc_id, runs (array of start, length, period), the collapsed text and four numbers of the greatest run of each row.

    With repeat_some the texts are those of planted(). No row moves; a task refines about TEXT_BYTES of whole texts at once, or one
    longer text, and never looks beyond the periods that a run can have. Defined cases: a null or empty text has no words
    and no runs; every repeated row gives its own; a null doc_id is carried through and plants nothing; of runs that are equal
    in length over period the first counts as greatest; an empty table gives an empty result; other columns are left out.
    """
    prepare(docs.sparkSession)
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def each(batches):
        for whole in gathered(batches, "text", TEXT_BYTES):
            for piece in pieces(whole, "text", TEXT_BYTES):
                ids = piece.column("doc_id").to_pylist()
                texts = [(x.as_py() or "").encode("utf-8", "surrogatepass").split() for x in piece.column("text")]
                if repeat_some:
                    texts = [planted(w, i) for w, i in zip(texts, ids, strict=True)]
                found = runs(texts)
                best = [longest(r) or (None, None, None) for r in found]
                yield pa.RecordBatch.from_arrays([
                    piece.column("doc_id"), pa.array([[dict(zip(("start", "length", "period"), x, strict=True)) for x in r] for r in found], pa.list_(run)),
                    pa.array([b" ".join(collapsed(w, r)) for w, r in zip(texts, found, strict=True)], pa.string()),
                    *(pa.array([b[i] for b in best], pa.int64()) for i in range(3)), pa.array([None if b[0] is None else 1000 * b[1] // b[2] for b in best], pa.int64()),
                ], ["doc_id", "runs", "collapsed", "start", "length", "period", "exponent_milli"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(each, "doc_id long, runs array<struct<start long, length long, period long>>, collapsed string, start long, length long, period long, exponent_milli long")


def runs_digest(docs: DataFrame) -> DataFrame:
    """runs_table() of planted texts with the runs and the collapsed text as SHA-256 digests."""
    found = runs_table(docs, repeat_some=True)
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "start", "length", "period", "exponent_milli",
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
