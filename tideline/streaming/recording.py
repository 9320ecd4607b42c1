"""The states of a recorder as a stream, and the update of a bounded cache."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tideline.streaming.grouped import GROUPS, in_groups, names

OUT = "device string, at_ms long, event string"


class Recorder(StatefulProcessor):
    """Watches for activity, begins a session, and ends it.

    Started begins a session: `began` follows at once if the recorder is ready (Ready within `tries` retries, `wait_ms` apart),
    else the session is abandoned. Stopped and Idle abandon a session that has not begun, and end one that has. Interrupt exits.
    A group's devices share one state, without those that watch, and one timer, the earliest of their deadlines.
    """

    def __init__(self, tries: int, wait_ms: int) -> None:
        self.tries, self.wait_ms = tries, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("phases", "device array<string>, phase array<string>, tried array<int>, next array<long>")
        self.handle = handle

    def _step(self, held: tuple, at: int, kind: str, out: list) -> tuple:
        phase, tried, due = held
        while phase == "beginning" and due is not None and at >= due:
            tried += 1
            if tried < self.tries:
                due += self.wait_ms
            else:
                out.append((due, "abandoned"))  # when the last try was due, not when the next event tells of it
                phase, due = "watching", None
        if phase == "watching" and kind == "Started":
            return "beginning", 0, at + self.wait_ms
        if phase == "beginning" and kind == "Ready":
            out.append((at, "began"))
            return "recording", 0, None
        if phase == "beginning" and kind in ("Stopped", "Idle", "Interrupt"):
            out.append((at, "abandoned"))
            return ("exited" if kind == "Interrupt" else "watching"), 0, None
        if phase == "recording" and kind in ("Stopped", "Idle", "Interrupt"):
            out.append((at, "ended"))
            return ("exited" if kind == "Interrupt" else "watching"), 0, None
        return ("exited" if kind == "Interrupt" else phase), tried, due

    def _held(self) -> dict:
        return {d: tuple(x) for d, *x in zip(*self.state.get(), strict=True)} if self.state.exists() else {}

    def _deadline(self, held: tuple) -> int | None:
        """When the last try is due."""
        return None if held[2] is None else held[2] + self.wait_ms * max(0, self.tries - held[1] - 1)

    def _keep(self, held: dict) -> None:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        held = {d: x for d, x in held.items() if x[0] != "watching"}
        if not held:
            return self.state.clear()
        self.state.update((list(held), *map(list, zip(*held.values(), strict=True))))
        if due := [t for t in map(self._deadline, held.values()) if t is not None]:
            self.handle.registerTimer(min(due))

    def _frame(self, out: dict) -> pd.DataFrame:
        return pd.DataFrame([(d, *x) for d, found in out.items() for x in found], columns=["device", "at_ms", "event"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, out = self._held(), {}
        came = pd.concat(list(rows)).sort_values(["ts_ms", "kind"])
        for device, at, kind in zip(names(came["device"]), came["ts_ms"], came["kind"], strict=True):
            held[device] = self._step(held.get(device, ("watching", 0, None)), int(at), kind, out.setdefault(device, []))
        self._keep(held)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, out, now = self._held(), {}, max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        for device, x in held.items():
            if (due := self._deadline(x)) is not None and due <= now:
                held[device] = self._step(x, due, "", out.setdefault(device, []))
        self._keep(held)
        yield self._frame(out)

    def close(self) -> None:
        pass


def recorder_stream(events: DataFrame, tries: int = 5, wait_ms: int = 2000, watermark: str = "10 seconds", groups: int = GROUPS) -> DataFrame:
    """events (a stream): device, ts timestamp, ts_ms long, kind (Started, Ready, Stopped, Idle, Interrupt). Needs the RocksDB
    state store. Emits what happens to sessions: device, at_ms, event (began, ended, abandoned). State is held by groups of devices."""
    return in_groups(events.withWatermark("ts", watermark), "device", groups).transformWithStateInPandas(Recorder(tries, wait_ms), OUT, "append", "eventtime")


def queue_update(fifo: DataFrame, chunk: DataFrame, keys: list[str], frame: str, most: int = 40, at_least: int = 300) -> tuple[DataFrame, DataFrame]:
    """A bounded queue after a chunk: what stays in it and what leaves it for the cache, oldest first.

    Where queue and chunk hold more than `most` rows, `at_least` of the oldest leave, or as many as are too many, but no more
    than there are. frame orders both; the chunk's come after the queue's. A cache that the leaving rows overfill is compressed
    (cache.compress).
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    both = fifo.withColumn("_c", F.lit(0)).unionByName(chunk.withColumn("_c", F.lit(1)))
    n = F.count("*").over(Window.partitionBy(*keys))
    both = both.withColumn("_n", n).withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy("_c", frame)))
    leaves = (F.col("_n") > most) & (F.col("_i") <= F.greatest(F.lit(at_least), F.col("_n") - most))
    return both.filter(~leaves).drop("_c", "_n", "_i"), both.filter(leaves).drop("_c", "_n", "_i")


def track_sink(samples: DataFrame, path: str, checkpoint: str, every: str = "5 seconds", once: bool = False):  # noqa: ANN201
    """Writes a stream of samples to files under path, committed every few seconds; a reader sees whole commits only. With
    once=True what is there is written and the stream ends."""
    writer = samples.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
