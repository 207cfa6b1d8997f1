"""Files (S1-S6, S14)."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Headers by which a payment export's columns are known, best first.
PAYMENT_HEADERS = {
    "student_id": ["student_id", "学号", "消费卡号", "card_no", "cardno", "帐号", "账号", "个人编号"],
    "student_name": ["student_name", "姓名", "name"],
    "transaction_time": ["transaction_time", "消费时间", "time", "datetime", "交易时间"],
    "amount": ["amount", "金额", "消费金额", "price", "交易金额"],
    "transaction_id": ["transaction_id", "流水号", "serial_no", "serialno", "交易流水号", "钱包流水号"],
    "transaction_location": ["transaction_location", "交易地点", "消费地点", "交易场所", "商户", "商户名称", "终端名称"],
}
# Headers of ids that are unique for one wallet alone.
WEAK_ID_HEADERS = {"钱包流水号"}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def by_ids(df: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows with these keys."""
    return df.where(F.col(key).isin(list(ids)))


def detected_encoding(sample: bytes) -> str:
    """utf-8 if the bytes are (a character cut off at the end aside), else GB18030, which has GBK in it."""
    for cut in range(4):
        try:
            sample[: len(sample) - cut].decode("utf-8-sig")
            return "utf-8"
        except UnicodeDecodeError:
            continue
    return "gb18030"


def sample_bytes(spark: SparkSession, path: str, n: int = 1 << 16) -> bytes:
    """The first bytes of the first file of a path, wherever Spark reads it from."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = [s.getPath() for s in fs.listStatus(at)] if fs.getFileStatus(at).isDirectory() else [at]
    first = sorted((p for p in files if not p.getName().startswith(("_", "."))), key=lambda p: p.getName())[:1]
    if not first:
        return b""
    size = min(n, fs.getFileStatus(first[0]).getLen())
    stream = fs.open(first[0])
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, size)) if size else b""
    finally:
        stream.close()


def csv_strings(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """A CSV with a header, all columns strings, headers trimmed (S3). Another encoding than Spark's own
    few turns on spark.sql.legacy.javaCharsets for the session: the scan looks at it when it runs."""
    encoding = encoding or detected_encoding(sample_bytes(spark, path))
    if encoding != "utf-8":
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    df = spark.read.option("header", True).option("encoding", encoding).option("multiLine", encoding != "utf-8").csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def excel_strings(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """Workbooks as strings, one task a file (S4). All must have the first one's header; needs a pandas
    Excel engine on the executors."""

    def cells(data: bytes) -> pd.DataFrame:
        return pd.read_excel(io.BytesIO(data), sheet_name=sheet, dtype=str)

    books = spark.read.format("binaryFile").load(path)
    header = cells(bytes(books.select("content").first()["content"])).columns
    names = [str(c).strip() for c in header]

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                rows = cells(data)
                rows.columns = [str(c).strip() for c in rows.columns]
                yield rows.reindex(columns=names).astype(object).where(lambda x: x.notna(), None)

    return books.select("content").mapInPandas(of, ", ".join(f"`{n}` string" for n in names))


def suggested_mapping(columns: list[str], headers: dict[str, list[str]] = PAYMENT_HEADERS) -> dict[str, str]:
    """Field -> column: the first alias that a column has, whatever the case; of columns alike the last."""
    known = {c.lower(): c for c in columns}
    return {field: known[a.lower()] for field, aliases in headers.items() for a in reversed(aliases) if a.lower() in known}


def preview(df: DataFrame, n: int = 10) -> dict:
    """Columns, the first rows with blanks for nulls, the mapping suggested, and the number of rows."""
    rows = [{k: v if v is not None else "" for k, v in r.asDict().items()} for r in df.limit(n).collect()]
    return {"columns": df.columns, "rows": rows, "mapping": suggested_mapping(df.columns), "total": df.count()}


def frames(spark: SparkSession, path: str, pattern: str = "*.npy") -> DataFrame:
    """Extracted frames, named <channel>_<frame number>.npy: (channel_id, frame_no, frame bytes)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        F.regexp_extract(name, r"^(.*)_(\d+)\.[^.]*$", 1).alias("channel_id"),
        F.regexp_extract(name, r"^(.*)_(\d+)\.[^.]*$", 2).try_cast("int").alias("frame_no"),
        F.col("content").alias("frame"),
    )


def images(spark: SparkSession, path: str) -> DataFrame:
    """(image_path, data) of image files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("image_path"), F.col("content").alias("data"))
