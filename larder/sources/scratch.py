"""Tables written to cut lineage, in the folder that all executors reach (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder is made and set if there is one machine
    only, as in tests; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        found = "file://" + tempfile.mkdtemp(prefix="larder-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one operator. `put` writes a table under a name and frees the one of that name before it;
    all go when the application ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_folder(self.spark)}/larder-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self._files(path, lambda fs, at: fs.deleteOnExit(at))
        before, self.paths[name] = self.paths.get(name), path
        if before:
            self._files(before, lambda fs, at: fs.delete(at, True))
        return self.spark.read.schema(df.schema).parquet(path)

    def _files(self, path: str, do) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        do(at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at)


def small(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """A stored table of a few keys and numbers a row, marked for broadcast while it has at most `most_rows`
    (some 20 MB as a hash table); a larger one is marked for a shuffled join, since Spark itself would send up
    to a million rows of such a table, compressed to less than its threshold, through the driver."""
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df.hint("merge")
