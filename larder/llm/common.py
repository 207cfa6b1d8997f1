"""What the corpus operators share: tables written to break lineage, row keys, bitmaps, and connected
components."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # of a query that has ended


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir. Where that is unset, a temporary folder
    is made and set if the master is local, as in tests; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        found = "file://" + tempfile.mkdtemp(prefix="larder-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """`df` as a Parquet table in the shared folder, and its path: lineage ends there, and losing an
    executor costs nothing that was written. The table goes when the application ends, or with `dropped`.
    What was shuffled to write it goes as soon as it is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/larder-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    fs, at = _file(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return stored(df, name)[0]


def dropped(spark: SparkSession, path: str) -> None:
    """Frees a stored table that nothing will read any more."""
    fs, at = _file(spark, path)
    fs.delete(at, True)


def _file(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class Tables:
    """Stored tables of one job, freed by name as soon as nothing will read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        table, path = stored(df, name)
        self.paths.setdefault(name, []).append(path)
        return table

    def drop(self, *names: str) -> None:
        for name in names:
            for path in self.paths.pop(name, []):
                dropped(self.spark, path)


def handed_back(of: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """`of`, for mapInArrow; when a task is over, the memory that its batches took goes back to the system,
    for Python workers live on after it."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from of(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return run


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """`names`, each with as many underscores in front as it takes to differ from all `columns`."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def sized(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A stored table of keys and a few numbers, marked for broadcast while it has at most `most` rows (some
    100 MB as a hash table); a larger one is left to a shuffled join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def row_key(*columns: str | Column) -> tuple[Column, Column]:
    """128 bits, as two longs, that tell rows apart by these columns; rows alike in them share a key."""
    return F.xxhash64(F.lit(17), *columns), F.xxhash64(F.lit(29), *columns)


def marked(values: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of `bits` bits (a power of two) with those of the column's values set, each modulo `bits`.
    Built by aggregation, 32,768 bits a row."""
    v = F.pmod(F.col(values.columns[0]), F.lit(bits)) + 1
    rows = values.select(v.alias("v")).groupBy(F.bitmap_bucket_number("v").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("bits")).collect()
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in rows:
        out[(r["at"] - 1) * 4096 : r["at"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def bits_for(n: int, least: int = 1 << 16, most: int = 1 << 28) -> int:
    """Bits of a bitmap for `n` values: eight a value, so that few others are let through, and at most
    `most`, 32 MB. Beyond that a bitmap prunes less; nothing may rely on it but speed."""
    return min(max(least, 1 << (8 * n).bit_length()), most)


def is_marked(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = (values.view(np.uint64) & np.uint64(len(bits) * 8 - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def crc_remainder(doc_id: str | Column) -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as empty text."""
    found = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(found.cast("string"), F.lit(""))) % 3


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of `edges` (a long, b long): (node, component), component being the smallest
    node reachable. Only nodes that have an edge to another node appear.

    Alternating large-star and small-star rounds: a round is two joins on the edge table, hubs are
    reduced by partial aggregation (min), and rounds grow with the logarithm of the longest path. Each
    round is written to the shared folder, so no lineage builds up; the round before is freed.
    """
    spark = edges.sparkSession
    now, path = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    last = None
    for _ in range(max_rounds):
        both = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        before = path
        now, path = stored(small, "edges")
        dropped(spark, before)
        state = now.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("h")).first()
        if state == last or not state["n"]:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
