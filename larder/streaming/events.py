"""The machines on Spark: one group per key in a batch, keyed state in a stream."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from larder.streaming import machines as M
from larder.streaming.background import walked


def _machine(kind: str) -> tuple[Callable, Callable, Callable | None]:
    return (M.new_tray, M.tray_step, None) if kind == "tray_selector" else (M.new_state, M.step, M.flush)


def _events(state: dict, frames: pd.DataFrame, step: Callable, s: M.Settings) -> list[dict]:
    found = []
    for frame in frames.to_dict("records"):
        event = step(state, frame, s)
        if event is not None:
            found.append(event)
    return found


def events(frames: DataFrame, key: str = "channel_id", kind: str = "legacy", settings: M.Settings = M.Settings()) -> DataFrame:
    """(key, event columns) of all frames. A key is one recording, whose frames a task walks in order,
    holding the machine's state and no history. A null motion score is neither motion nor none."""
    start, step, flush = _machine(kind)

    def take(state: dict, frame: dict) -> list[dict]:
        state["last"] = frame["frame_no"]
        score = frame.get("motion_score")
        event = step(state["machine"], frame | {"motion_score": float("nan") if score is None else score}, settings)
        return [event] if event else []

    def over(state: dict) -> list[dict]:
        event = flush(state["machine"], state["last"], settings) if flush else None
        return [event] if event else []

    return walked(frames, key, M.EVENT_SCHEMA, lambda: {"machine": start(), "last": 0}, take, over)


def event_stream(frames: DataFrame, key: str = "channel_id", kind: str = "legacy", settings: M.Settings = M.Settings(), idle_ms: int = 60_000) -> DataFrame:
    """As events, on a stream. Frames of a key must come in order of batches; within a batch they are
    sorted. A row with end_of_video, or `idle_ms` without frames, flushes a key and drops its state."""
    start, step, flush = _machine(kind)

    def of(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, last = (json.loads(held.get[0]), held.get[1]) if held.exists else (start(), 0)
        found, over = [], held.hasTimedOut
        if not over:
            pdf = pd.concat(list(batches)).sort_values("frame_no")
            marks = pdf["end_of_video"].eq(True)
            over = bool(marks.any())
            frames = pdf[~marks]
            found = _events(state, frames, step, settings)
            last = int(max([last, *frames["frame_no"].tolist()]))
        if over:
            event = flush(state, last, settings) if flush else None
            found += [event] if event else []
            held.remove()
        else:
            held.update((json.dumps(state, default=float), last))
            held.setTimeoutDuration(idle_ms)
        out = pd.DataFrame(found, columns=M.EVENT_COLUMNS)
        out.insert(0, key, k[0])
        yield out

    kind_of = frames.schema[key].dataType.simpleString()
    return frames.groupBy(key).applyInPandasWithState(of, f"{key} {kind_of}, {M.EVENT_SCHEMA}", "state string, last int", "append", GroupStateTimeout.ProcessingTimeTimeout)


def matched_stream(records: DataFrame, images: DataFrame, seconds: float = 1.0, late: str = "10 minutes") -> DataFrame:
    """All record-image pairs of a band, as a stream-stream join with watermarks on both sides, which
    bound its state. records: (record_id, record_time, amount), images: (image_id, image_time, total).

    Streams join on equal keys alone: as in band_join, an image stands in its bucket of time and both
    neighbours, a record in its own."""
    width = max(seconds, 1.0)
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (width * 1_000_000))
    r = records.withWatermark("record_time", late).withColumn("_bucket", bucket("record_time"))
    near = F.explode(F.sequence(bucket("image_time") - 1, bucket("image_time") + 1))
    i = images.withWatermark("image_time", late).withColumn("_bucket", near).withColumnRenamed("_bucket", "_near")
    band = f"image_time BETWEEN record_time - INTERVAL {seconds} SECONDS AND record_time + INTERVAL {seconds} SECONDS"
    return r.join(i, F.expr(f"_bucket = _near AND {band}")).drop("_bucket", "_near")


def due(sources: DataFrame, tasks: DataFrame, now, trigger: str, zone: str) -> DataFrame:
    """Sources to sync now: past the local trigger time, with no task of that local date that waits, runs
    or succeeded (T10). sources: (source_id), tasks: (source_id, task_date, status)."""
    local = F.from_utc_timestamp(F.lit(now), zone)
    done = tasks.where((F.col("task_date") == F.to_date(local)) & F.col("status").isin("pending", "running", "success"))
    return sources.where(F.date_format(local, "HH:mm") >= trigger).join(done.select("source_id"), "source_id", "left_anti")
