"""Sorting, pages and top-k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def page_of(page, size, default: int = 20, most: int = 100) -> tuple[int, int]:
    """Page and size of a request: at least 1, at most `most`; both fall back if either is no number."""
    try:
        return max(1, int(page)), max(1, min(int(size), most))
    except (TypeError, ValueError):
        return 1, default


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of the ordered rows; `order` should end with a unique key (L1)."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_counts(df: DataFrame, number: int, size: int) -> DataFrame:
    """(total, page, page_size, total_pages)."""
    return df.agg(F.count("*").alias("total")).select(
        "total", F.lit(number).alias("page"), F.lit(size).alias("page_size"), F.ceil(F.col("total") / size).alias("total_pages")
    )


def top(df: DataFrame, k: int, by: list[str], order: list[Column], rank: str | None = None) -> DataFrame:
    """The first k rows of each group. Spark drops rows beyond k before the shuffle."""
    out = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= k)
    return out.withColumnRenamed("_n", rank) if rank else out.drop("_n")


def latest(df: DataFrame, by: list[str], at: str, tie: str | None = None, rest: list[str] | None = None, also: Sequence[Column] = ()) -> DataFrame:
    """The row of each group with the latest time, as an aggregate; of equals that with the largest `tie`,
    else the largest hash of the row (L3, L4, W10). A row is its `rest`, all other columns where not said;
    `also` are aggregates of the whole group, kept beside it."""
    rest = [c for c in rest or df.columns if c not in by]
    order = F.struct(F.col(at), *([F.col(tie)] if tie else []), F.xxhash64(*rest))
    found = df.groupBy(*by).agg(F.max_by(F.struct(*rest), order).alias("_r"), *also)
    return found.select(*by, "_r.*", *found.columns[len(by) + 1 :])


def capped_regions(regions: DataFrame, key: str, order: list[Column], score: str, good: Column, most: int = 6) -> DataFrame:
    """The first `most` regions in the detector's order, then those that are good, best first, numbered
    anew (L6, W8)."""
    first = top(regions, most, [key], order)
    return first.where(good).withColumn("region", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(score), *order)))
