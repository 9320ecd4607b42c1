"""State that streams carry from chunk to chunk: a bounded queue with a compressed cache behind it, and bounded references."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideline.streaming.grouped import GROUPS, in_groups

#: Rows that go out at once.
OUT_ROWS = 20_000
CACHE_OUT = "session long, chunk long, part string, position long, frame long, probs array<double>"
REFERENCES_OUT = "name string, upto long, ord long, clip_s double"


@dataclass(frozen=True)
class CacheRule:
    """A queue of `queue` frames, `at_least` of which leave it when it runs over; a cache of `capacity` rows. The rest is what
    cache.compress takes: `least` scores above zero, `strong` and `weak` raised frames, `latest` for new ones, `silence` rows."""

    slots: int = 4
    queue: int = 40
    at_least: int = 300
    capacity: int = 188
    least: int = 3
    strong: int = 4
    weak: int = 8
    latest: float = 0.05
    silence: int = 2
    floor: float = 1e-6


def kept_rows(probs: np.ndarray, rule: CacheRule) -> list[int | None]:
    """Which rows of a cache (frames x slots, oldest first) stay, slot by slot; None is the silence row."""
    n, slots = probs.shape
    quiet = np.log(np.maximum(1 - probs, rule.floor))
    raw = np.round(np.log(np.maximum(probs, rule.floor)) - quiet + quiet.sum(axis=1, keepdims=True) - np.log(0.5), 9)
    raw[probs <= 0.5] = -np.inf
    score = np.where((raw > 0) | ((raw > 0).sum(axis=0) < rule.least), raw, -np.inf)
    score[rule.capacity :] = np.round(score[rule.capacity :] + rule.latest, 9)
    half = 0.6931471805599453
    for count, amount in ((rule.strong, 2 * half), (rule.weak, half)):
        best = np.argsort(-score, axis=0, kind="stable")[:count]
        for s in range(slots):
            score[best[:, s], s] = np.round(score[best[:, s], s] + amount, 9)
    whole = np.vstack([score, np.full((rule.silence, slots), np.inf)])
    order = sorted(((-whole[f, s], s, f) for s in range(slots) for f in range(n + rule.silence)))[: rule.capacity]
    stays = sorted((s, f) for minus, s, f in order if minus < np.inf)
    return [f if f < n else None for _, f in stays] + [None] * (len(order) - len(stays))


class CarriedCache(StatefulProcessor):
    """The queue and the cache of a session, from chunk to chunk.

    A chunk's frames after the last known one join the queue. Frames known before are new estimates: they count for what is in
    the queue, and in the cache as long as it was never compressed, as its rows are in order until then. When the queue runs
    over, its oldest frames move to the cache, and a cache that runs over is compressed. A group's sessions share one state.
    """

    def __init__(self, rule: CacheRule) -> None:
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        frames = "frame array<long>, probs array<double>"
        self.state = handle.getValueState("sessions", f"session array<long>, last array<long>, compressed array<boolean>, queued array<int>, cached array<int>, {frames}")

    def _held(self) -> dict:
        """Queue, cache, last frame and whether it was ever compressed, by session."""
        if not self.state.exists():
            return {}
        *sessions, frame, probs = self.state.get()
        slots, rows = self.rule.slots, iter(range(len(frame)))
        take = lambda n: [(frame[i], list(probs[i * slots : (i + 1) * slots])) for _, i in zip(range(n), rows)]  # noqa: B905, E731
        return {s: (take(queued), take(cached), last, compressed) for s, last, compressed, queued, cached in zip(*sessions, strict=True)}

    def _keep(self, held: dict) -> None:
        rows = [r for queue, cache, *_ in held.values() for r in queue + cache]
        queues, caches, last, compressed = zip(*held.values(), strict=True)
        self.state.update((list(held), list(last), list(compressed), [len(q) for q in queues], [len(c) for c in caches], [f for f, _ in rows], [x for _, p in rows for x in p]))

    def _after(self, told: dict, queue: list, cache: list, last: int, compressed: bool) -> tuple[list, list, int, bool]:
        """The session's state after a chunk."""
        queue = [(f, told.get(f, p)) for f, p in queue] + [(f, p) for f, p in told.items() if f > last]
        cache = cache if compressed else [(f, told.get(f, p)) for f, p in cache]
        if (over := len(queue) - self.rule.queue) > 0:
            leave = min(max(self.rule.at_least, over), len(queue))
            cache, queue = cache + queue[:leave], queue[leave:]
        if len(cache) > self.rule.capacity:
            nobody = (None, [0.0] * self.rule.slots)
            cache = [nobody if i is None else cache[i] for i in kept_rows(np.array([p for _, p in cache]), self.rule)]
            compressed = True
        return queue, cache, max([last, *told]), compressed

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out = self._held(), []
        came = pd.concat(list(rows)).sort_values(["session", "chunk", "frame"])
        each = zip(came["session"].tolist(), came["chunk"].tolist(), came["frame"].tolist(), came["probs"], strict=True)
        for (session, chunk), part in groupby(each, lambda r: (None if r[0] != r[0] else int(r[0]), int(r[1]))):
            told = {int(f): [float(x) for x in p] for _, _, f, p in part}
            held[session] = queue, cache, *_ = self._after(told, *held.get(session, ([], [], -1, False)))
            for name, rows_ in (("cache", cache), ("queue", queue)):
                out += [(session, chunk, name, i, f, p) for i, (f, p) in enumerate(rows_)]
            if len(out) >= OUT_ROWS:
                yield self._frame(out)
                out = []
        self._keep(held)
        yield self._frame(out)

    def _frame(self, out: list) -> pd.DataFrame:
        frame = pd.DataFrame(out, columns=["session", "chunk", "part", "position", "frame", "probs"])
        return frame.astype({"session": "Int64", "chunk": "int64", "position": "int64", "frame": "Int64"})

    def close(self) -> None:
        pass


def cache_stream(frames: DataFrame, rule: CacheRule, groups: int = GROUPS) -> DataFrame:
    """frames (a stream): session long, chunk long, frame long, probs array<double> (a probability for each slot). Needs the
    RocksDB state store. Emits queue and cache of a session after each of its chunks.

    Chunks of a session come in order. A frame given twice in a chunk counts with one of its rows; a chunk without new frames changes
    estimates only; an empty stream gives nothing. State is a queue and a cache a session, both of bounded size, held by groups of sessions.
    """
    return in_groups(frames, "session", groups).transformWithStateInPandas(CarriedCache(rule), CACHE_OUT, "append", "none")


def last_states(states: DataFrame) -> DataFrame:
    """Of what cache_stream() emitted, the rows after each session's last chunk."""
    last = states.groupBy(F.col("session").alias("_s")).agg(F.max("chunk").alias("_last"))
    return states.join(last, (F.col("session") == F.col("_s")) & (F.col("chunk") == F.col("_last"))).drop("_s", "_last")


class BoundedReferences(StatefulProcessor):
    """A name's references, offer by offer; see assign.reservoir for the rule."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("held", "ord long, vector long, clip_s double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.held.get()] if self.held.exists() else []
        upto, timed = None, lambda x: x is not None and x == x
        for r in pd.concat(list(rows)).sort_values("ord").itertuples():
            upto, offer = int(r.ord), (int(r.ord), int(r.vector), float(r.clip_s) if timed(r.clip_s) else None)
            if any(offer[1] == h[1] for h in held):
                continue
            if len(held) < self.capacity:
                held.append(offer)
            elif timed(offer[2]) and (clips := [h for h in held if timed(h[2])]):
                least = min(clips, key=lambda h: (h[2], h[0]))
                if offer[2] > least[2]:
                    held[held.index(least)] = offer
        self.held.put(held)
        yield pd.DataFrame([(key[0], upto, o, c) for o, _, c in held], columns=["name", "upto", "ord", "clip_s"]).astype({"clip_s": "float64"})

    def close(self) -> None:
        pass


def references_stream(offers: DataFrame, capacity: int = 10) -> DataFrame:
    """offers (a stream): name string, ord long, vector long (a number that stands for the vector), clip_s double. Needs the
    RocksDB state store. Emits, for each name that a batch has offers for, all its references and upto, the last offer's ord.

    Offers of a name come in order; equal numbers are equal vectors; a null or NaN clip_s is not timed and is never replaced.
    """
    return offers.groupBy("name").transformWithStateInPandas(BoundedReferences(capacity), REFERENCES_OUT, "append", "none")


def last_references(states: DataFrame) -> DataFrame:
    """Of what references_stream() emitted, each name's last set: name, ord, clip_s."""
    last = states.groupBy(F.col("name").alias("_n")).agg(F.max("upto").alias("_last"))
    return states.join(last, (F.col("name") == F.col("_n")) & (F.col("upto") == F.col("_last"))).select("name", "ord", "clip_s")
