"""Listings of recorders and services as tables. Fetching is injected; what the answers mean is here
(S7-S12, S15, S16)."""

from __future__ import annotations

import time
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.operators.merge import last_of

RECORDINGS = "filename string, start_time string, end_time string, download_url string, size bigint"


def track_id(channel: int) -> int:
    """The main stream of a channel."""
    return channel * 100 + 1


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def recording_time(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", "+00:00"))


def search_time(at: datetime, zone: str) -> str:
    """A time of a search, in UTC; without a zone it is in `zone`."""
    local = at.replace(tzinfo=ZoneInfo(zone)) if at.tzinfo is None else at
    return local.astimezone(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def recordings_of_xml(text: str | bytes, channel: str = "1") -> list[tuple]:
    """(name, start, end, uri, size) of a search answer, whatever its name space; items without a start,
    an end or an address drop out (S8). A recording is named by channel and second of its start, times are
    ISO, and its size isn't known: 0."""
    out = []
    for item in ET.fromstring(text).iter():
        if _tag(item) != "searchMatchItem":
            continue
        values = {_tag(e): (e.text or "").strip() for e in item.iter()}
        start, end, uri = (values.get(k, "") for k in ("startTime", "endTime", "playbackURI"))
        if start and end and uri:
            began = recording_time(start)
            out.append((f"cam{channel}_{int(began.timestamp())}.mp4", began.isoformat(), recording_time(end).isoformat(), uri, 0))
    return out


def recordings(answers: DataFrame, column: str = "xml", channel: str | None = None) -> DataFrame:
    """RECORDINGS of XML answers, parsed where they lie; an answer that isn't XML, or holds a time that is
    none, gives none (S7, S8). `channel` is the column that says whose answer it is."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text, own in zip(pdf["_xml"], pdf["_channel"]):
                try:
                    rows += recordings_of_xml(text, own)
                except (ET.ParseError, TypeError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=["filename", "start_time", "end_time", "download_url", "size"])

    own = F.col(channel).cast("string") if channel else F.lit("1")
    return answers.select(F.col(column).alias("_xml"), own.alias("_channel")).mapInPandas(of, RECORDINGS)


def channels(streams: DataFrame, stream: str = "stream_id", order: str = "pos") -> DataFrame:
    """One stream per channel, the channel being its id less two characters (an id of two or fewer is the
    channel itself): the first listed. Streams without an id go (S9)."""
    trimmed = F.trim(stream)
    channel = F.when(F.length(trimmed) > 2, F.substring(trimmed, F.lit(1), F.length(trimmed) - 2)).otherwise(trimmed)
    w = Window.partitionBy("channel_id").orderBy(order)
    first = streams.where(trimmed != "").withColumn("channel_id", channel).withColumn("_n", F.row_number().over(w))
    return first.where("_n = 1").drop("_n")


def last_channels(listed: DataFrame, channel: str = "channel_id", order: str = "pos") -> DataFrame:
    """Of each channel the last listed, its id trimmed; blank ids go."""
    named = listed.withColumn(channel, F.trim(channel)).where(F.col(channel) != "")
    return last_of(named, [channel], [F.col(order)])


def channel_name(channel: Column, name: Column) -> Column:
    """The name of a channel, trimmed; without one a name made of its id."""
    # fixed values: the default names
    default = F.when(channel == "1", "主通道").otherwise(F.concat(F.lit("通道 "), channel))
    return F.when(F.trim(F.coalesce(name, F.lit(""))) != "", F.trim(name)).otherwise(default)


def numeric_first(column: str) -> list[Column]:
    """An order that puts ids of digits alone first, by value, then texts."""
    digits = F.col(column).rlike("^[0-9]+$")
    return [~digits, F.when(digits, F.col(column).try_cast("decimal(38,0)")), F.col(column)]


def active_source(sources: DataFrame) -> DataFrame:
    """The source in use: enabled, active, the latest changed."""
    order = [F.desc("is_active"), F.desc("updated_at"), F.desc("id")]
    return sources.where("is_active and status = 'enabled'").orderBy(*order).limit(1)


class Adapters:
    """Source types and what builds their readers."""

    def __init__(self, **builders: Callable):
        self.builders = builders

    def build(self, kind: str, *args, **options):
        if kind not in self.builders:
            raise ValueError(f"unknown source type: {kind}")
        return self.builders[kind](*args, **options)


def fetch_pages(fetch: Callable[[int, int], dict], size: int = 100) -> Iterator[dict]:
    """Items of a paged service, by offset until it has no more (S12). A page without items that promises
    more is an error: it would be asked for without end."""
    offset = 0
    while True:
        answer = fetch(offset, size)
        yield from answer["items"]
        offset += size
        if not answer.get("has_more"):
            return
        if not answer["items"]:
            raise RuntimeError(f"the service has more, but gave no items at offset {offset - size}")


def paged(spark: SparkSession, keys: DataFrame, fetch: Callable[[str, int, int], dict], schema: str, size: int = 100) -> DataFrame:
    """Items of a paged service for each key (a department, say), fetched by the executors."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key in pdf.iloc[:, 0]:
                yield pd.DataFrame(list(fetch_pages(lambda o, n, key=key: fetch(key, o, n), size)))

    return keys.mapInPandas(of, schema)


def retried(call: Callable, tries: int = 3, wait: float = 1.0, sleep: Callable = time.sleep):
    """`call`, tried again after 1, 2, 4 ... waits; the last error is raised."""
    for i in range(tries):
        try:
            return call()
        except Exception:
            if i + 1 == tries:
                raise
            sleep(wait * 2**i)


class RateLimit:
    """At most n calls in any `seconds`, for one worker."""

    def __init__(self, n: int = 10, seconds: float = 1.0, clock: Callable = time.monotonic, sleep: Callable = time.sleep):
        self.n, self.seconds, self.clock, self.sleep, self.calls = n, seconds, clock, sleep, []

    def wait(self) -> None:
        now = self.clock()
        self.calls = [t for t in self.calls if now - t < self.seconds]
        if len(self.calls) >= self.n:
            self.sleep(self.seconds - (now - self.calls[0]))
            now = self.clock()
            self.calls = [t for t in self.calls if now - t < self.seconds]
        self.calls.append(now)


def called(rows: DataFrame, call: Callable[[dict], dict], schema: str, limit: int = 10) -> DataFrame:
    """An answer per row of a remote model, one client a task, errors as rows (S16). call gives {"code",
    "data", "message"}; any code but 0 is an error. schema: of the result, with a column `error`."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate = RateLimit(limit)
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                gate.wait()
                try:
                    answer = retried(lambda row=row: call(row))
                    good = answer.get("code", -1) == 0
                    out.append({**row, **(answer["data"] if good else {}), "error": None if good else str(answer.get("message", answer.get("code")))})
                except Exception as e:  # noqa: BLE001
                    out.append({**row, "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(out)

    return rows.mapInPandas(of, schema)


def only_one(**values):
    """The one value given of several inputs that exclude each other."""
    given = {k: v for k, v in values.items() if v not in (None, "")}
    if len(given) != 1:
        raise ValueError(f"exactly one of {', '.join(values)} is needed")
    return next(iter(given.items()))
