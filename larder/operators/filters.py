"""Predicates and projections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.text import stripped


def projected(df: DataFrame, numbers: list[str] = (), times: list[str] = (), rest: list[str] = ()) -> DataFrame:
    """Rows as a service returns them: numbers as doubles, times as ISO text, others as they are."""
    return df.select(
        *rest, *(F.col(c).cast("double").alias(c) for c in numbers),
        *(F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias(c) for c in times),
    )


def given(df: DataFrame, **values) -> DataFrame:
    """Equality on each column whose value isn't None."""
    return reduce(lambda d, kv: d.filter(F.col(kv[0]) == kv[1]) if kv[1] is not None else d, values.items(), df)


def flag(text: str | None, default: bool, words: tuple[str, ...] = ("1", "true", "yes", "all")) -> bool:
    """A flag of a request: unless it defaults to True, it takes a word to turn it on; else "false" turns it off (P5)."""
    if text is None:
        return default
    return text.strip().lower() != "false" if default else text.strip().lower() in words


def in_list(df: DataFrame, column: str, values: list, most_literals: int = 500) -> DataFrame:
    """Rows whose value is listed. An empty list gives no rows without a scan; a long one is joined."""
    if not values:
        return df.limit(0)
    if len(values) <= most_literals:
        return df.filter(F.col(column).isin(list(values)))
    wanted = df.sparkSession.createDataFrame([(v,) for v in set(values)], f"{column} {df.schema[column].dataType.simpleString()}")
    return df.join(wanted, column, "left_semi")


def contains(text: str, *columns: str) -> Column:
    """Case-insensitive %text% in any of the columns; % and _ in the text are wildcards too."""
    return reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{text}%") for c in columns])


def same_name(column: str, text: str, wildcards: bool = True) -> Column:
    """Case-insensitive equality; with `wildcards` % and _ match loosely, without they are letters."""
    return F.col(column).ilike(text) if wildcards else F.lower(column) == text.lower()


def scoped(df: DataFrame, role: str, classes: list[str], grades: list[str], class_column: str = "class_id", grade_column: str = "grade_id") -> DataFrame:
    """Rows that a role may list: teachers their classes, grade leaders their grades, admins all."""
    if role == "admin":
        return df
    column, ids = {"teacher": (class_column, classes), "grade_leader": (grade_column, grades)}.get(role, (class_column, []))
    return in_list(df, column, ids)


def may_read(role: Column, student_ids: Column, classes: Column, grades: Column, student: Column, class_id: Column, grade_id: Column) -> Column:
    """Whether a user may read a student's report."""
    has = lambda xs, x: F.coalesce(F.array_contains(xs, x), F.lit(False))
    return (
        F.when(role == "admin", True)
        .when(role == "parent", has(student_ids, student))
        .when(role == "teacher", has(classes, class_id))
        .when(role == "grade_leader", has(grades, grade_id))
        .otherwise(False)
    )


def staled(tasks: DataFrame, now, kinds: list[str], hours: int = 6) -> DataFrame:
    """Active tasks of `kinds` that began over `hours` ago and didn't end become failed."""
    stale = F.col("task_type").isin(kinds) & F.col("status").isin("pending", "running") & F.col("finished_at").isNull() & (F.col("started_at") < F.lit(now) - F.expr(f"INTERVAL {hours} HOURS"))
    return tasks.withColumns({
        "status": F.when(stale, "failed").otherwise(F.col("status")),
        "finished_at": F.when(stale, F.lit(now)).otherwise(F.col("finished_at")),
    })


# States from which a task may take each step.
STEPS = {"retry": ["failed", "partial"], "cancel": ["pending", "running"]}


def may_step(status: Column, step: str) -> Column:
    return status.isin(STEPS[step])


def required(*columns: str) -> Column:
    """All columns hold more than white space."""
    return reduce(lambda a, b: a & b, [F.coalesce(stripped(F.col(c).cast("string")), F.lit("")) != "" for c in columns])


def first_error(*checks: tuple[Column, str]) -> Column:
    """The message of the first check that fails, null if none does (P20, P21). A check that is null fails."""
    out = F.lit(None).cast("string")
    for good, message in reversed(checks):
        out = F.when(~F.coalesce(good, F.lit(False)), F.lit(message)).otherwise(out)
    return out


def nested_active(parents: DataFrame, children: DataFrame, key: str, name: str, order: list[str]) -> DataFrame:
    """Parents with their active children as an ordered array; parents without any have an empty one."""
    columns = [c for c in children.columns if c not in (key, "is_active")]
    front = [*order, *(c for c in columns if c not in order)]
    kids = children.filter("is_active").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*front))).alias(name))
    empty = F.array().cast(kids.schema[name].dataType)
    return parents.join(kids, key, "left").withColumn(name, F.coalesce(name, empty))
