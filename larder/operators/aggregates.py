"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.numbers import half_even, mean, nutrient_score
from larder.operators.paging import top
from larder.operators.quantiles import exact_quantiles


def counts_of(df: DataFrame, column: str, values: list[str], total: str = "total", by: list[str] | None = None) -> DataFrame:
    """Rows in all and of each value, in one pass."""
    return df.groupBy(*(by or [])).agg(F.count("*").alias(total), *(F.count_if(F.col(column) == v).alias(v) for v in values))


def most(df: DataFrame, column: str, out: str, default=0) -> DataFrame:
    """MAX, or `default` for no rows (A4)."""
    return df.agg(F.coalesce(F.max(column), F.lit(default)).alias(out))


def exists_for(df: DataFrame, key: str, of: DataFrame, out: str = "found") -> DataFrame:
    """Keys of `of` with whether `df` has any row of theirs (A5)."""
    any_ = df.select(key).where(F.col(key).isNotNull()).distinct().withColumn(out, F.lit(True))
    return of.select(key).distinct().join(any_, key, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def daily_log(
    matches: DataFrame, recognitions: DataFrame, items: DataFrame, nutrients: list[str], group: list[str], match: str = "match_id", image: str = "image_id", item: str = "item_id", groups: DataFrame | None = None
) -> DataFrame:
    """Per group: sums of the items' nutrients, number of matches, and the set of items (A8, J13). `groups`
    get a row even without matches.

    Two matches on one image count its items twice. Matches are counted apart from the exploding join,
    so that those without items count once and those with many do too.
    """
    # matches are narrow and few beside recognitions: hashed, they spare both sides a sort
    totals = (
        recognitions.join(matches.select(*group, image).hint("shuffle_hash"), image)
        .join(items, item)
        .groupBy(*group)
        .agg(*(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in nutrients), F.array_sort(F.collect_set(item)).alias("items"))
    )
    counted = matches.select(*group, match)
    if groups is not None:
        counted = counted.unionByName(groups.select(*group, F.lit(None).alias(match)))
    meals = counted.groupBy(*group).agg(F.count_distinct(match).alias("meal_count"))
    none = F.array().cast(totals.schema["items"].dataType)
    return meals.join(totals, group, "left").select(
        *group, "meal_count", *(F.coalesce(n, F.lit(0)).alias(n) for n in nutrients), F.coalesce("items", none).alias("items")
    )


def period_averages(logs: DataFrame, people: DataFrame, key: str, nutrients: list[str], digits: int = 1) -> DataFrame:
    """Per person: days with meals and the mean of each nutrient over them, half-even; 0 without any."""
    means = (
        logs.where("meal_count > 0")
        .groupBy(key)
        .agg(F.count("*").alias("meal_days"), *(half_even(mean(F.coalesce(n, F.lit(0))), digits).alias(n) for n in nutrients))
    )
    return people.select(key).join(means, key, "left").select(
        key, F.coalesce("meal_days", F.lit(0)).alias("meal_days"), *(F.coalesce(n, F.lit(0)).cast("double").alias(n) for n in nutrients)
    )


def frequent_items(logs: DataFrame, key: str, names: DataFrame, item: str = "item_id", k: int = 5) -> DataFrame:
    """Per person the k items of most days, before names are looked up, so unknown ones leave gaps (A10).
    Of equal counts the smaller id."""
    counts = logs.where("meal_count > 0").select(key, F.explode("items").alias(item)).groupBy(key, item).agg(F.count("*").alias("days"))
    return top(counts, k, [key], [F.desc("days"), F.col(item)], "rank").join(names, item)


def ratio_alerts(averages: DataFrame, key: str, recommended: dict[str, float], low: float = 0.6, high: float = 1.5, least_days: int = 3, digits: int | None = 2) -> DataFrame:
    """(key, ordinal, nutrient, type, ratio): a row for each nutrient far from its recommendation, for
    people with `least_days` days (A11). The ratio is rounded, unless `digits` is None."""
    long = averages.where(F.col("meal_days") >= least_days).select(
        key,
        F.posexplode(F.array(*(F.struct(F.lit(n).alias("nutrient"), (F.col(n) / r).alias("ratio")) for n, r in recommended.items()))).alias("ordinal", "x"),
    )
    kind = F.when(F.col("x.ratio") < low, "deficiency").when(F.col("x.ratio") > high, "excess")
    ratio = F.col("x.ratio") if digits is None else half_even(F.col("x.ratio"), digits)
    return long.select(key, "ordinal", "x.nutrient", kind.alias("type"), ratio.alias("ratio")).where("type is not null")


def score(recommended: dict[str, float]) -> Column:
    """A12."""
    return nutrient_score([F.col(n) for n in recommended], list(recommended.values()))


def group_report(people: DataFrame, averages: DataFrame, alerts: DataFrame, key: str, group: str, nutrients: list[str], recommended: dict[str, float]) -> DataFrame:
    """Per group of active people: how many, mean of their means, mean score, and how many have alerts;
    people without meals count as 0 (A13)."""
    flagged = alerts.select(key).distinct().withColumn("flag", F.lit(1))
    each = people.where("is_active").join(averages, key).join(flagged, key, "left").withColumn("score", score(recommended))
    return each.groupBy(group).agg(
        F.count("*").alias("people"), *(half_even(mean(F.col(n)), 1).alias(n) for n in nutrients),
        half_even(mean(F.col("score")), 0).cast("int").alias("score"), F.count("flag").alias("flagged"),
    )


def no_meal_alerts(logs: DataFrame, key: str, today, days: int = 5, least_logs: int = 3) -> DataFrame:
    """People with `least_logs` logs in the last `days` days and no meal in any."""
    since = F.date_sub(F.lit(today).cast("date"), days)
    return logs.where(F.col("log_date") >= since).groupBy(key).agg(F.count("*").alias("logs"), F.sum(F.coalesce("meal_count", F.lit(0))).alias("meals")).where(f"logs >= {least_logs} and meals = 0").select(key, "logs")


def alerts_for(users: DataFrame, people: DataFrame, alerts: DataFrame, key: str, per_class: int = 20, at_most: int = 50) -> DataFrame:
    """(user_id, key): parents see their children's alerts, teachers those of the first `per_class` active
    people of each class, each user `at_most` (A15)."""
    first = top(people.where("is_active"), per_class, ["class_id"], [F.col(key)]).select(key, "class_id")
    parents = users.where("role = 'parent'").select("user_id", F.explode("student_ids").alias(key))
    teachers = users.where("role = 'teacher'").select("user_id", F.explode("managed_class_ids").alias("class_id")).join(first, "class_id").select("user_id", key)
    return top(parents.unionByName(teachers).join(alerts.select(key), key), at_most, ["user_id"], [F.col(key)])


def outcome(*rules: tuple[Column, str], otherwise: str) -> Column:
    """The first rule that holds names a row's outcome, to be counted."""
    out = F.lit(otherwise)
    for holds, name in reversed(rules):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def push_status(sent: Column, failed: Column) -> Column:
    """sent without errors, with no recipient too; failed if all failed; else partial."""
    return F.when(failed == 0, "sent").when(sent == 0, "failed").otherwise("partial")


def baselines(df: DataFrame, by: list[str], column: str, out: str, q: float = 0.1) -> DataFrame:
    """Exact percentile with linear interpolation (A20), of groups of any size."""
    return exact_quantiles(df, by, column, {out: q})


def dominant(values: dict[str, Column], least: float = 60.0) -> Column:
    """The name of the largest value, the first of equals, if it is `least` or more."""
    best = F.array_max(F.array(*(F.struct(v.alias("v"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, v) in enumerate(values.items()))))
    return F.when(best["v"] >= least, best["n"])


def distinct_union(*lists: Column) -> Column:
    """Elements in order of first mention."""
    return F.array_distinct(F.flatten(F.array(*(F.coalesce(x, F.array()) for x in lists))))


def progress(manifest: DataFrame, present: DataFrame, name: str = "path", size: str = "size") -> DataFrame:
    """(files, done, bytes, done_bytes, percent): by bytes where sizes are known, else by files."""
    both = manifest.join(present.select(name).distinct().withColumn("_here", F.lit(1)), name, "left")
    sums = both.agg(
        F.count("*").alias("files"), F.count("_here").alias("done"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum(F.when(F.col("_here") == 1, F.col(size))), F.lit(0)).alias("done_bytes"),
    )
    part = F.when(F.col("bytes") > 0, F.col("done_bytes") / F.col("bytes")).when(F.col("files") > 0, F.col("done") / F.col("files")).otherwise(0.0)
    return sums.withColumn("percent", half_even(F.least(F.greatest(part * 100, F.lit(0.0)), F.lit(100.0)), 1))
