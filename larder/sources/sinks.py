"""Sinks (K1, K2, K9-K13)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.vectors import normalised

# Fields of an event record, in order (K9).
EVENT_FIELDS = ["timestamp", "image_path", "candidate_frame_count", "best_score", "frame_no", "peak_frame_no", "diff_score", "low_quality", "quality_note"]


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """K1."""
    df.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Overwrites only the partitions that `df` has, so that a run may be repeated (K2)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    """Event records as JSON lines, scores to six digits (K9)."""
    rounded = {c: F.round(F.col(c), 6) for c in ("best_score", "diff_score")}
    events.withColumns(rounded).select(*EVENT_FIELDS).write.mode("append").json(path)


def image_names(events: DataFrame, channel: str = "channel_id", at: str = "captured_at", order: str = "frame_no") -> DataFrame:
    """<channel>_<time>.jpg, with milliseconds from the second of a second on."""
    second = F.date_format(at, "yyyy-MM-dd-HH-mm-ss")
    w = Window.partitionBy(channel, F.date_trunc("second", at)).orderBy(order)
    millis = F.format_string("-%03d", F.pmod(F.unix_millis(F.col(at).cast("timestamp")), F.lit(1000)))
    name = F.concat(F.col(channel), F.lit("_"), second, F.when(F.row_number().over(w) > 1, millis).otherwise(F.lit("")), F.lit(".jpg"))
    return events.withColumn("image_name", name)


def public_columns(df: DataFrame) -> list[Column]:
    """Columns that may leave: none that begins with an underscore."""
    return [F.col(c) for c in df.columns if not c.startswith("_")]


class VersionedTable:
    """A table whose readers see whole versions: each is written to a folder of its own, then a pointer
    file is set to it (S13, K11, K12). A failed write leaves the old version in place."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def version(self) -> str | None:
        fs, at = self._fs(f"{self.path}/current")
        if not fs.exists(at):
            return None
        return json.loads(self.spark.read.text(f"{self.path}/current").first()[0])["version"]

    def write(self, df: DataFrame, name: str | None = None, vector: str | None = None) -> str:
        """`vector` names a column of vectors, which an index holds at length 1 and in single precision."""
        name = name or uuid.uuid4().hex
        if vector:
            df = df.withColumn(vector, normalised(F.col(vector)).cast("array<float>"))
        if "/" in name or name.startswith("."):
            raise ValueError(f"not a version name: {name}")
        df.write.parquet(f"{self.path}/versions/{name}")
        fs, at = self._fs(f"{self.path}/current.{name}")
        out = fs.create(at, True)
        out.write(bytearray(json.dumps({"version": name}).encode()))
        out.close()
        _, current = self._fs(f"{self.path}/current")
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(at, current, options)
        return name

    def read(self, schema: str | None = None) -> DataFrame:
        """The current version; without one an empty table of `schema`."""
        name = self.version()
        if name is None:
            if schema is None:
                raise FileNotFoundError(self.path)
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.path}/versions/{name}")
