"""Ordered computations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.python import log
from larder.operators.quantiles import exact_quantiles


def neighbour_difference(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The mean of the absolute differences to the row before and after; 0 for a row alone."""
    w = Window.partitionBy(*by).orderBy(*order)
    one, two = F.abs(F.col(value) - F.lag(value).over(w)), F.abs(F.lead(value).over(w) - F.col(value))
    n = one.isNotNull().cast("int") + two.isNotNull().cast("int")
    return df.withColumn(out, F.when(n == 0, 0.0).otherwise((F.coalesce(one, F.lit(0.0)) + F.coalesce(two, F.lit(0.0))) / n))


def min_max(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Scaled to 0..1 within a group; 1 where all are alike."""
    w = Window.partitionBy(*by)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, F.when(high - low < 1e-9, 1.0).otherwise((F.col(value) - low) / (high - low)))


def hard_filtered(df: DataFrame, by: list[str], multiplier: float = 1.8, exposure: float = 0.05) -> DataFrame:
    """Candidates whose difference is near the group's median and whose exposure is fair."""
    median = exact_quantiles(df, by, "temporal_diff", {"_median": 0.5})
    limit = F.greatest(F.col("_median") * multiplier, F.col("_median") + 2.0)
    return df.join(median, by).where((F.col("temporal_diff") <= limit) & (F.col("exposure_outlier_ratio") <= exposure)).drop("_median")


def ranked_frames(df: DataFrame, by: list[str], clarity: float = 0.6, completeness: float = 0.4) -> DataFrame:
    """Candidates with clarity, score and rank in their group."""
    logs = ["laplacian", "tenengrad", "local_clarity"]
    out = df.withColumns({f"_{c}": log(1 + F.greatest(F.lit(0.0), F.col(c))) for c in logs})
    scaled = [(f"_{c}", f"_n_{c}") for c in logs] + [("high_freq_ratio", "_n_freq"), ("completeness", "_n_complete")]
    for source, target in scaled:
        out = min_max(out, by, source, target)
    out = out.withColumn("clarity", 0.35 * F.col("_n_laplacian") + 0.35 * F.col("_n_tenengrad") + 0.20 * F.col("_n_local_clarity") + 0.10 * F.col("_n_freq"))
    out = out.withColumn("score", clarity * F.col("clarity") + completeness * F.col("_n_complete"))
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("clarity"), "edge_touch_ratio", "center_distance_ratio", "frame_no")
    return out.withColumn("rank", F.row_number().over(order)).select(*df.columns, "clarity", "score", "rank")


def duplicates_marked(df: DataFrame, by: list[Column], order: list[str], out: str = "is_candidate") -> DataFrame:
    """All but the first row of a group are candidates."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) > 1)


def streaks(df: DataFrame, by: list[str], order: list[str], state: Column, out: str = "streak") -> DataFrame:
    """How many rows in a row, up to this one, have had its state."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = F.coalesce((F.lag("_state").over(w) != F.col("_state")), F.lit(True)).cast("int")
    run = Window.partitionBy(*by, "_run").orderBy(*order)
    return df.withColumn("_state", state).withColumn("_change", changed).withColumn("_run", F.sum("_change").over(w)).withColumn(out, F.row_number().over(run)).drop("_state", "_change", "_run")


def best_of_last(df: DataFrame, by: list[str], order: list[str], n: int, what: str, score: str, out: str) -> DataFrame:
    """`what` of the best-scored of the last n rows, the earliest of equals."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn(out, F.max_by(F.col(what), F.struct(F.col(score), -F.col(order[0]))).over(w))


def running_peak(df: DataFrame, by: list[str], order: list[str], value: str, at: str, out: str) -> DataFrame:
    """Where the running maximum was met last."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.max_by(F.col(at), F.struct(F.col(value), F.col(at))).over(w))


def evenly(df: DataFrame, by: list[str], order: list[str], most: int) -> DataFrame:
    """At most `most` rows of each group, evenly spread over its order, first and last included."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    n = F.count("*").over(Window.partitionBy(*by))
    places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda j: F.bround(j * (F.col("_n") - 1) / max(1, most - 1)).cast("long"))
    out = df.withColumns({"_at": at.cast("long"), "_n": n}).where((F.col("_n") <= most) | F.array_contains(places, F.col("_at")))
    return out.drop("_at", "_n")
