"""Services as Spark sources (S7, S8, S12): paged listings, recorders' searches, and files fetched in ranges.

    spark.dataSource.register(Pages)
    spark.read.format("pages").schema("id long, name string").option("service", "my.module:connect").load()

`service` names a callable, `module:name`, that tasks import and call with the options; what it gives back
talks to the service. So credentials and clients live where they are used, and the plan holds names only.
"""

from __future__ import annotations

import importlib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from larder.sources.listings import RECORDINGS, recordings_of_xml


def connected(options: dict):
    """What the callable named by option `service` gives."""
    module, _, name = options.get("service", "").partition(":")
    if not (module and name):
        raise ValueError("option service must be module:callable")
    return getattr(importlib.import_module(module), name)(options)


@dataclass
class Range(InputPartition):
    """Items from start on; stop is None where the service tells no total."""

    start: int
    stop: int | None


def _batch(items: list[dict], schema: StructType) -> pa.RecordBatch:
    """Items as rows of `schema`, by name: what an item lacks is null, what it has besides is left out."""
    target = to_arrow_schema(schema)
    return pa.RecordBatch.from_pylist([{f.name: item.get(f.name) for f in target} for item in items], schema=target)


def _pages(service, part: Range, size: int) -> Iterator[list[dict]]:
    at = part.start
    while part.stop is None or at < part.stop:
        answer = service.page(at, size if part.stop is None else min(size, part.stop - at))
        items = answer["items"]
        if items:
            yield items
        at += len(items)
        if part.stop is None and not answer.get("has_more"):
            return
        if not items:
            raise RuntimeError(f"the service has more, but gave no items at offset {at}")


class Pages(DataSource):
    """A paged service: page(offset, size) gives {"items", "has_more"}, and total() the number of items or None.

    With a total, ranges of `task_items` items are fetched by tasks of their own; without, one task goes
    from page to page until there are no more. A page without items where there should be some is an error: no row is
    lost in silence. Reading as a stream takes items in the order of the service, which must only append;
    the offset is the number of items taken. Options: service, page_size (100), task_items (10,000).
    """

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        raise ValueError("give the schema of the items")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PageReader(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _PageStream(schema, dict(self.options))


class _Paged:
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.size, self.task_items = int(options.get("page_size", 100)), int(options.get("task_items", 10_000))

    def _ranges(self, start: int, stop: int) -> list[Range]:
        return [Range(at, min(at + self.task_items, stop)) for at in range(start, stop, self.task_items)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        service = connected(self.options)
        for items in _pages(service, partition, self.size):
            yield _batch(items, self.schema)


class _PageReader(_Paged, DataSourceReader):
    def partitions(self) -> list[Range]:
        total = connected(self.options).total()
        return [Range(0, None)] if total is None else self._ranges(0, total)


class _PageStream(_Paged, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"taken": 0}

    def latestOffset(self) -> dict:
        total = connected(self.options).total()
        if total is None:
            raise ValueError("a service that tells no total can't be read as a stream")
        return {"taken": total}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self._ranges(start["taken"], end["taken"])

    def commit(self, end: dict) -> None:
        pass


@dataclass
class Window(InputPartition):
    channel: str
    start: str
    end: str


class Recordings(DataSource):
    """Recordings of channels between two times (S7, S8): a task for each channel and `hours` of time.

    The service has search(channel, start, end), which gives either the XML of a search answer or a list of
    dicts as RECORDINGS. A window that can't be searched, or whose answer isn't XML, gives no rows; if the
    schema has a column error, it gives one that says why. A recording over the end of a window is found in
    each; take distinct rows. Options: service, channels (comma-separated), start, end (ISO), hours (24).
    """

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return f"channel_id string, {RECORDINGS}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _RecordingReader(schema, dict(self.options))


class _RecordingReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options

    def partitions(self) -> list[Window]:
        o = self.options
        start, end = datetime.fromisoformat(o["start"]), datetime.fromisoformat(o["end"])
        step, out = timedelta(hours=float(o.get("hours", 24))), []
        for channel in filter(None, (c.strip() for c in o["channels"].split(","))):
            at = start
            while at < end:
                out.append(Window(channel, at.isoformat(), min(at + step, end).isoformat()))
                at += step
        return out or [Window("", "", "")]

    def read(self, partition: Window) -> Iterator[pa.RecordBatch]:
        found = []
        if partition.channel:
            try:
                answer = connected(self.options).search(partition.channel, datetime.fromisoformat(partition.start), datetime.fromisoformat(partition.end))
                if isinstance(answer, (str, bytes)):
                    names = [x.split()[0] for x in RECORDINGS.split(", ")]
                    answer = [dict(zip(names, row)) for row in recordings_of_xml(answer, partition.channel)]
                found = [{"channel_id": partition.channel, **r} for r in answer]
            except (OSError, ET.ParseError, ValueError) as e:
                found = [{"channel_id": partition.channel, "error": f"{type(e).__name__}: {e}"}] if "error" in self.schema.names else []
        yield _batch(found, self.schema)


def fetched(fetch: Callable[[int], Iterator[bytes]], size: int | None, path: str, fs, tries: int = 3) -> int:
    """Bytes of a file fetched to `path` of `fs` (a pyarrow file system), in order and whole.

    fetch(offset) gives the bytes from there on. They go to `path`.part; what a broken connection leaves
    there is kept and the fetch goes on behind it. Only a file of the right size takes its name; a size of None is taken
    as it comes. A `path` that is there already isn't fetched again.
    """
    from pyarrow.fs import FileType

    part, where = f"{path}.part", fs.get_file_info(path)
    if where.type == FileType.File and (size is None or where.size == size):
        return where.size
    for attempt in range(tries):
        there = fs.get_file_info(part)
        have = there.size if there.type == FileType.File else 0
        if size is not None and have > size:
            fs.delete_file(part)
            have = 0
        try:
            if size is None or have < size:
                with fs.open_append_stream(part) if have else fs.open_output_stream(part) as out:
                    for chunk in fetch(have):
                        out.write(chunk)
            now = fs.get_file_info(part).size
            if size is not None and now != size:
                raise OSError(f"{now} of {size} bytes")
            fs.move(part, path)
            return now
        except OSError:
            if attempt + 1 == tries:
                raise
    raise OSError("no attempt was made")


def downloaded(recordings: DataFrame, folder: str, tries: int = 3, **options: str) -> DataFrame:
    """(filename, path, bytes, error): each recording fetched into `folder`, a URI that executors reach, by
    the task that holds its row; one that fails is a row with its error. The service (option `service`) has read(url, offset) and
    may have size(url). `recordings` as RECORDINGS; one of a name is fetched."""

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        service = connected(options)
        fs, base = FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for pdf in batches:
            out = []
            for name, url, size in zip(pdf["filename"], pdf["download_url"], pdf["size"]):
                try:
                    known = service.size(url) if hasattr(service, "size") else int(size) if size and size == size else None
                    n = fetched(lambda at, url=url: service.read(url, at), known or None, f"{base}/{name}", fs, tries)
                    out.append((name, f"{base}/{name}", n, None))
                except Exception as e:  # noqa: BLE001  what a client raises is unknown
                    out.append((name, None, None, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["filename", "path", "bytes", "error"]).astype({"bytes": "Int64"})

    one = recordings.groupBy("filename").agg(F.min("download_url").alias("download_url"), F.max("size").alias("size"))
    return one.mapInPandas(of, "filename string, path string, bytes long, error string")

