"""Live activity with a grace period, as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideline.streaming.grouped import GROUPS, in_groups, names

OUT = "key string, started_ms long, ended_ms long, reason string"


class GraceSessions(StatefulProcessor):
    """Started opens a session. Stopped arms one deadline that later Stopped events do not extend; Started disarms it;
    Interrupt ends the session at once; a deadline that passes ends it at the time of the first Stopped. A group's keys share one
    state, their open sessions, and one timer, the earliest of their deadlines."""

    def __init__(self, grace_ms: int) -> None:
        self.grace_ms = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("sessions", "key array<string>, started array<long>, stopped array<long>")
        self.handle = handle

    def _held(self) -> dict:
        return {k: (s, e) for k, s, e in zip(*self.state.get(), strict=True)} if self.state.exists() else {}

    def _keep(self, held: dict) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if not held:
            return self.state.clear()
        self.state.update((list(held), [s for s, _ in held.values()], [e for _, e in held.values()]))
        if armed := [e for _, e in held.values() if e is not None]:
            self.handle.registerTimer(min(armed) + self.grace_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out = self._held(), []
        came = pd.concat(list(rows)).sort_values(["ts_ms", "kind"])
        for name, at, kind in zip(names(came["key"]), came["ts_ms"], came["kind"], strict=True):
            started, stopped = held.pop(name, (None, None))
            if started is not None and stopped is not None and at >= stopped + self.grace_ms:
                out.append((name, started, stopped, "stopped"))
                started = stopped = None
            if kind == "Started":
                started, stopped = (int(at) if started is None else started), None
            elif kind == "Stopped" and started is not None and stopped is None:
                stopped = int(at)
            elif kind == "Interrupt" and started is not None:
                out.append((name, started, int(at), "interrupt"))
                started = stopped = None
            if started is not None:
                held[name] = (started, stopped)
        self._keep(held)
        yield pd.DataFrame(out, columns=["key", "started_ms", "ended_ms", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, now = self._held(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        over = {k: x for k, x in held.items() if x[1] is not None and x[1] + self.grace_ms <= now}
        self._keep({k: x for k, x in held.items() if k not in over})
        yield pd.DataFrame([(k, *x, "stopped") for k, x in over.items()], columns=["key", "started_ms", "ended_ms", "reason"])

    def close(self) -> None:
        pass


def grace_stream(events: DataFrame, grace_ms: int, watermark: str = "10 seconds", groups: int = GROUPS) -> DataFrame:
    """events (a stream): key, ts timestamp, ts_ms long, kind. Needs the RocksDB state store. Emits closed sessions. State is held
    by groups of keys."""
    return in_groups(events.withWatermark("ts", watermark), "key", groups).transformWithStateInPandas(GraceSessions(grace_ms), OUT, "append", "eventtime")
