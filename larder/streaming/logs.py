"""Daily logs kept up to date as matches come in (A8, K2): only what a batch touches is computed anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from larder.operators.aggregates import daily_log
from larder.operators.paging import latest
from larder.sources.scratch import Scratch
from larder.sources.sinks import replace_partitions

COUNTED = ("matched", "confirmed")


class DailyLogs:
    """Two tables in `folder`, in partitions of a `unit` of days: matches as they are now, and a log for each
    person and day.

    A batch holds new or changed matches (match_id, image_id, person, day, status, and `version`, a number
    that grows); a match keeps its day. Of the rows of a match the highest version counts, so a batch that
    comes twice, or comes late, changes nothing. The partitions of the days that a batch names are read and
    replaced: persons and days that it names, and those that its matches belonged to before, get new logs
    from their matches; other logs are kept as they are. A crash between the two tables is mended by the
    batch that Spark then repeats. Give a unit of few enough partitions: month, week or day.
    """

    def __init__(self, spark: SparkSession, folder: str, recognitions: DataFrame, items: DataFrame, nutrients: list[str], person: str = "student_id", day: str = "log_date", unit: str = "month"):
        self.spark, self.matches_at, self.logs_at = spark, f"{folder}/matches", f"{folder}/logs"
        self.recognitions, self.items, self.nutrients, self.person, self.day, self.unit = recognitions, items, nutrients, person, day, unit

    def apply(self, batch: DataFrame, batch_id: int = 0) -> None:
        """For foreachBatch."""
        scratch, keys = Scratch(self.spark), [self.person, self.day]
        batch = scratch.put(batch.where(F.col(self.day).isNotNull() & F.col("match_id").isNotNull()), "batch")
        parts = [r[0] for r in batch.select(self._part()).distinct().collect()]  # the partitions to replace
        if not parts:
            return
        # each match as it is now, whether the batch names it, and whose it was
        before = self._of(self.matches_at, parts, batch)
        both = before.withColumn("_named", F.lit(False)).unionByName(batch.withColumn("_named", F.lit(True)))
        was = F.max(F.when(~F.col("_named"), F.struct(*keys))).alias("_was")
        now = scratch.put(latest(both, ["match_id"], "version", rest=batch.columns, also=[F.max("_named").alias("_named"), was]), "matches")
        named, counts = now.where("_named"), F.col("status").isin(*COUNTED) & F.col(self.person).isNotNull()
        touched = scratch.put(named.select(*keys).unionByName(named.select("_was.*")).where(F.col(self.person).isNotNull() & F.col(self.day).isNotNull()).distinct(), "touched")
        others_counted = now.where(counts & ~F.col("_named")).join(touched, keys, "left_semi")
        counted = scratch.put(named.where(counts).unionByName(others_counted).select(*keys, "match_id", "image_id"), "counted")
        # whoever has no counted match left keeps a row that says so: a partition without rows wouldn't be replaced
        found = daily_log(counted, self.recognitions, self.items, self.nutrients, keys, groups=touched)
        logs = self._of(self.logs_at, parts, found).join(touched, keys, "left_anti").unionByName(found)
        # logs first: once matches are replaced, whose they were is gone
        for table, path in ((logs, self.logs_at), (now.select(*batch.columns), self.matches_at)):
            replace_partitions(table.withColumn("_part", self._part()).hint("rebalance", "_part"), path, ["_part"])

    def logs(self) -> DataFrame:
        """The logs of persons and days with meals."""
        return self.spark.read.parquet(self.logs_at).where("meal_count > 0").drop("_part")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()

    def _part(self) -> Column:
        return F.date_format(F.date_trunc(self.unit, F.col(self.day)), "yyyyMMdd").cast("int").alias("_part")

    def _of(self, path: str, parts: list[int], like: DataFrame) -> DataFrame:
        """Some partitions of a table, none if there is no table yet."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return like.limit(0)
        schema = StructType([*like.schema.fields, StructField("_part", IntegerType())])
        return self.spark.read.schema(schema).parquet(path).where(F.col("_part").isin(parts)).drop("_part")
