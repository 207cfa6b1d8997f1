"""The event machines on event time (T3-T6): frames may come late and in any order.

Frames wait in keyed state until the watermark has passed them, then the machine takes them by time. So the
events of a replay are those of the frames, not of their arrival. State is typed: the machine's numbers, its
list, and the frames that wait. Timers on event time end a channel that has gone silent.

The session needs the RocksDB state store (`use_state_store`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larder.streaming import machines as M
from larder.streaming.events import _machine

_DOUBLES = ", ".join(f"{c} double" for c in M.FEATURES)
#: Of each machine: its numbers, the name of its list, what the list's elements hold, and what it reads of a frame.
_TYPES = {
    "legacy": (
        "stable boolean, quiet int, moving int, present int, sampled int, start int, peak double, peak_at int",
        "candidates", f"frame_no int, motion_score double, {_DOUBLES}",
        f"frame_no int, motion_score double, moving boolean, present boolean, {_DOUBLES}",
    ),
    "tray_selector": (
        "phase string, still int, away int, start int, peak double, peak_at int, last array<double>, last_food int",
        "buffer", "frame_no int, laplacian double, motion_score double, histogram array<double>, food_pixels int",
        "frame_no int, motion_score double, motion_pixels int, present boolean, laplacian double, histogram array<double>, food_pixels int",
    ),
}


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _plain(value):
    """What state can hold of a value from a frame: no numpy, no NaN."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    return None if isinstance(value, float) and value != value else value


class _Timed(StatefulProcessor):
    def __init__(self, key: str, kind: str, settings: M.Settings, idle_ms: int):
        self.key, self.kind, self.settings, self.idle = key, kind, settings, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        numbers, _, element, frame = _TYPES[self.kind]
        self.handle = handle
        self.numbers = handle.getValueState("numbers", numbers)
        self.elements = handle.getListState("elements", element)
        self.waiting = handle.getMapState("waiting", "at long, frame_no int", frame)
        self.last = handle.getValueState("last", "at long, frame_no int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names, latest = _names(_TYPES[self.kind][3]), 0
        for pdf in rows:
            for row in pdf.to_dict("records"):
                at = int(row["at_micros"])
                latest = max(latest, at)
                self.waiting.updateValue((at, int(row["frame_no"])), tuple(_plain(row.get(c)) for c in names))
        self._remind(latest)
        yield self._taken(key, timerValues.getCurrentWatermarkInMs(), False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        last = self.last.get() if self.last.exists() else None
        out = self._taken(key, now, last is not None and self._silent(now, last[0]))
        yield out

    def _silent(self, now: int, last: int) -> bool:
        ahead = [at for (at, _) in self.waiting.keys()]
        return now >= max([last, *[a for a in ahead if a <= now]]) // 1000 + self.idle

    def _remind(self, latest: int) -> None:
        """When the last frame is due, and when the channel is silent."""
        self.handle.registerTimer(latest // 1000 + 1)
        self.handle.registerTimer(latest // 1000 + self.idle)

    def _taken(self, key, watermark: int, over: bool) -> pd.DataFrame:
        """Events of the frames that the watermark has passed, and of the end if the channel is over. Frames
        further apart than `idle` belong to different recordings."""
        numbers, name, element, frame = _TYPES[self.kind]
        start, step, flush = _machine(self.kind)
        due = sorted(k for k in self.waiting.keys() if k[0] < watermark * 1000)
        found = []
        if due or over:
            state, last = self._load(start, numbers, name, element), self.last.get() if self.last.exists() else None

            def end() -> None:
                event = flush(state, last[1], self.settings) if flush and last else None
                found.extend([event] if event else [])
                state.clear()
                state.update(start())

            for k in due:
                if last is not None and k[0] - last[0] >= self.idle * 1000:
                    end()
                event = step(state, dict(zip(_names(frame), self.waiting.getValue(k))), self.settings)
                found += [event] if event else []
                self.waiting.removeKey(k)
                last = k
            if over and last is not None and watermark >= last[0] // 1000 + self.idle:
                end()
                self.numbers.clear()
                self.elements.clear()
                self.last.clear()
            else:
                self.numbers.update(tuple(_plain(state[c]) for c in _names(numbers)))
                self.elements.clear()
                if state[name]:
                    self.elements.put([tuple(_plain(x[c]) for c in _names(element)) for x in state[name]])
                if last is not None:
                    self.last.update(tuple(last))
        out = pd.DataFrame(found, columns=M.EVENT_COLUMNS)
        out.insert(0, self.key, key[0])
        return out

    def _load(self, start, numbers: str, name: str, element: str) -> dict:
        state = start()
        if self.numbers.exists():
            state |= dict(zip(_names(numbers), self.numbers.get()))
            state[name] = [dict(zip(_names(element), x)) for x in self.elements.get()]
        return state

    def close(self) -> None:
        pass


def timed_events(
    frames: DataFrame, at: str, key: str = "channel_id", kind: str = "legacy", settings: M.Settings = M.Settings(), late: str = "10 seconds", idle_ms: int = 60_000
) -> DataFrame:
    """(key, event columns) of a stream of frames with times in column `at`. Frames may come up to `late` after
    later ones; those that are later still are dropped. A channel whose next frame is `idle_ms` away, or
    doesn't come while the watermark moves on by as much, is over: what it holds is flushed and its state goes."""
    kind_of = frames.schema[key].dataType.simpleString()
    timed = frames.withColumn("at_micros", F.unix_micros(F.col(at).cast("timestamp"))).withWatermark(at, late)
    return timed.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_Timed(key, kind, settings, idle_ms), outputStructType=f"{key} {kind_of}, {M.EVENT_SCHEMA}", outputMode="Append", timeMode="EventTime"
    )
