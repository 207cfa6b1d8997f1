"""Exact percentiles of groups of any size, and deep pages, by narrowing down to the ranks that are asked for
(A20, A21, L1). No group is sorted or held in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.sources.scratch import Scratch, small


def exact_quantiles(df: DataFrame, by: list[str], value: str, quantiles: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """(by, a column for each of `quantiles`): quantiles with linear interpolation, in double precision;
    null values don't count, and a group without any others has nulls. NaN is larger than all numbers.

    An approximate quantile below and one above bound each rank; a scan counts what lies below the bounds
    and, by value, what lies between: a few thousandths of a group, equal values as one row. A running sum
    over these finds the rank. Counts show whether the bounds hold; where they don't they are moved apart
    and the scan is repeated, so that the result never rests on the sketch.
    """
    scratch = Scratch(df.sparkSession)
    rows = df.select(*by, F.col(value).cast("double").alias("_v"))
    names = list(quantiles)
    same = lambda a, b: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in by), F.lit(True))
    margin, found = 2.0 / accuracy, None
    todo = None
    while True:
        part = rows if todo is None else rows.join(small(todo), same(rows, todo), "left_semi")
        ends = [x for q in quantiles.values() for x in (max(0.0, q - margin), min(1.0, q + margin))]
        sketch = F.percentile_approx("_v", F.array(*map(F.lit, ends)), accuracy).alias("_ends")
        known = part.groupBy(*by).agg(F.count("_v").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), sketch)
        bounds = []
        for i, q in enumerate(quantiles.values()):
            wide = lambda at, edge, least: F.when(F.lit(least), F.col(edge)).otherwise(F.col("_ends")[at])
            at = F.lit(float(q)) * (F.col("_n") - 1)
            bounds.append(F.struct(
                F.lit(i).alias("i"), wide(2 * i, "_min", ends[2 * i] == 0.0).alias("low"), wide(2 * i + 1, "_max", ends[2 * i + 1] == 1.0).alias("high"),
                F.floor(at).alias("rank"), (at - F.floor(at)).alias("share"),
            ))
        known = scratch.put(known.where("_n > 0").select(*by, "_n", F.array(*bounds).alias("_bounds")), f"bounds-{margin}")
        right = small(known.select(*(F.col(c).alias(f"_k_{c}") for c in by), "_bounds"))
        match = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in by), F.lit(True))
        each = part.where("_v is not null").join(right, match).select(*by, "_v", F.explode("_bounds").alias("b"))
        # below the bounds all that counts is how many there are; between them, how many of each value
        key = F.when(F.col("_v") >= F.col("b.low"), F.col("_v"))
        counted = each.where(F.col("_v") <= F.col("b.high")).groupBy(*by, F.col("b.i").alias("_i"), key.alias("_v")).agg(F.count("*").alias("_same"))
        counted = scratch.put(counted, f"counted-{margin}")
        w = Window.partitionBy(*by, "_i").orderBy(F.col("_v").asc_nulls_first())
        placed = counted.withColumn("_end", F.sum("_same").over(w)).withColumn("_start", F.col("_end") - F.col("_same"))
        asked = known.select(*(F.col(c).alias(f"_k_{c}") for c in by), "_n", F.explode("_bounds").alias("b"))
        both = placed.join(small(asked), match & (F.col("_i") == F.col("b.i")))
        # one share of a step from the value of a rank to the next value
        pick = lambda rank: F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col("_v")))
        first, last = F.col("b.rank"), F.least(F.col("b.rank") + 1, F.col("_n") - 1)
        got = both.groupBy(*by, "_i").agg(pick(first).alias("_a"), pick(last).alias("_b"), F.first("b.share").alias("_share"))
        value_of = F.when(F.col("_share") == 0, F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_share"))
        got = got.withColumn("_q", value_of).where(F.col("_q").isNotNull())
        wide_ = scratch.put(got.groupBy(*by).agg(*(F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(c) for i, c in enumerate(names)), F.count("*").alias("_got")), f"got-{margin}")
        good = wide_.where(F.col("_got") == len(names)).drop("_got")
        found = good if found is None else found.unionByName(good)
        todo = known.select(*by).join(good, same(known, good), "left_anti") if by else known.select(F.lit(1)).limit(0 if good.count() else 1)
        todo = scratch.put(todo, f"todo-{margin}")
        if margin >= 1.0 or todo.isEmpty():
            break
        margin = min(1.0, margin * 32)
    groups = rows.select(*by).distinct() if by else rows.sparkSession.range(1).select()
    return groups.join(found, same(groups, found), "left").select(*(groups[c] for c in by), *names) if by else found


def _after(order: list[tuple[str, bool]], key: dict) -> Column:
    """Whether a row comes after `key`. order: (column, ascending); nulls come first in ascending order and
    last in descending order, as Spark sorts them."""
    out = F.lit(False)
    for column, up in reversed(order):
        c, x = F.col(column), key[column]
        if x is None:
            beyond = c.isNotNull() if up else F.lit(False)
        else:
            beyond = F.coalesce(c > F.lit(x), F.lit(False)) if up else F.coalesce(c < F.lit(x), F.lit(True))
        out = beyond | (c.eqNullSafe(F.lit(x)) & out)
    return out


def sorted_by(order: list[tuple[str, bool]]) -> list[Column]:
    return [F.asc(c) if up else F.desc(c) for c, up in order]


def page_after(df: DataFrame, order: list[tuple[str, bool]], last: dict | None, size: int) -> DataFrame:
    """The `size` rows that come after the row with the keys `last` (the first ones without it): a seek,
    which costs the same for any page (L1). `order` should end with a unique key."""
    rows = df if last is None else df.where(_after(order, last))
    return rows.orderBy(*sorted_by(order)).limit(size)


def deep_page(df: DataFrame, order: list[tuple[str, bool]], number: int, size: int) -> DataFrame:
    """Page `number` of the ordered rows, as paging.page gives it, without sorting all of them (L1).

    The keys alone are dealt into ranges; counts of the ranges say which of them hold the page, and only
    those are sorted. The page's rows are then looked up by their keys. `order` must end with a unique key.
    """
    keys, offset = [c for c, _ in order], (number - 1) * size
    scratch = Scratch(df.sparkSession)
    dealt = scratch.put(df.select(*keys).repartitionByRange(*sorted_by(order)).withColumn("_range", F.spark_partition_id()), "keys")
    counts = sorted((r["_range"], r["count"]) for r in dealt.groupBy("_range").count().collect())  # a row a partition
    wanted, skipped, before = [], 0, 0
    for part, n in counts:
        if before + n > offset and before < offset + size:
            wanted.append(part)
        elif before + n <= offset:
            skipped += n
        before += n
    page = dealt.where(F.col("_range").isin(wanted)).orderBy(*sorted_by(order)).offset(offset - skipped).limit(size).drop("_range")
    page = scratch.put(page, "page")
    same = reduce(lambda x, y: x & y, (df[c].eqNullSafe(page[c]) for c in keys))
    return df.join(F.broadcast(page), same, "left_semi").orderBy(*sorted_by(order))  # a page
