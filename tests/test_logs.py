"""Logs kept up to date batch by batch against all of them computed anew."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from larder.operators.aggregates import daily_log
from larder.streaming import logs as streaming_logs
from larder.streaming.logs import COUNTED, DailyLogs

COLUMNS = "match_id long, image_id long, student_id long, log_date date, status string, version int"


def batches(seed):
    rng, out = random.Random(seed), []
    day = {i: date(2024, 1, 1) + timedelta(days=i % 5) for i in range(200)}
    for version in range(4):
        some = rng.sample(range(200), 90)
        out.append([(i, rng.choice([None, i % 40]), rng.choice([1, 2, 3, None]), day[i], rng.choice([*COUNTED, "unmatched_record"]), version) for i in some])
    return out


def test_batches_give_what_a_full_recompute_gives(spark, tmp_path):
    seen = spark.createDataFrame([(i, i % 7) for i in range(40) for _ in range(i % 3)], "image_id long, item_id long")
    items = spark.createDataFrame([(i, float(i)) for i in range(6)], "item_id long, calories double")
    table = lambda rows: spark.createDataFrame(rows, COLUMNS)
    shown = lambda df: sorted(map(str, df.select("student_id", "log_date", "meal_count", "calories", "items").where("student_id is not null").collect()))

    def anew(parts):
        now = {}
        for r in sorted((r for p in parts for r in p), key=lambda r: r[5]):
            now[r[0]] = r
        kept = table(list(now.values())).where(F.col("status").isin(*COUNTED))
        return shown(daily_log(kept, seen, items, ["calories"], ["student_id", "log_date"]))

    parts = batches(1)
    logs = DailyLogs(spark, str(tmp_path / "a"), seen, items, ["calories"])
    for n, part in enumerate(parts):
        logs.apply(table(part), n)
        assert shown(logs.logs()) == anew(parts[: n + 1])
    logs.apply(table(parts[3]), 3)  # twice
    logs.apply(table(parts[1]), 4)  # late
    logs.apply(table([]), 5)
    assert shown(logs.logs()) == anew(parts)

    # as a stream, a file a batch
    for part in parts[:3]:
        table(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        streamed = DailyLogs(spark, str(tmp_path / "b"), seen, items, ["calories"])
        streamed.start(spark.readStream.schema(COLUMNS).parquet(str(tmp_path / "in")), str(tmp_path / "state")).awaitTermination(120)
    assert shown(streamed.logs()) == anew(parts[:3])


def test_other_days_are_not_touched(spark, tmp_path):
    seen = spark.createDataFrame([(1, 1)], "image_id long, item_id long")
    items = spark.createDataFrame([(1, 2.0)], "item_id long, calories double")
    logs = DailyLogs(spark, str(tmp_path), seen, items, ["calories"], unit="day")
    row = lambda i, d, s="matched", v=0: (i, 1, 1, date(2024, 1, d), s, v)
    logs.apply(spark.createDataFrame([row(1, 1), row(2, 2)], COLUMNS))
    first = {p: p.stat().st_mtime_ns for p in (tmp_path / "logs").rglob("*.parquet") if "_part=20240101" in str(p)}
    logs.apply(spark.createDataFrame([row(2, 2, "unmatched_record", 1), row(3, 3)], COLUMNS))
    assert first and first == {p: p.stat().st_mtime_ns for p in (tmp_path / "logs").rglob("*.parquet") if "_part=20240101" in str(p)}
    assert sorted(r["log_date"].day for r in logs.logs().collect()) == [1, 3]


def test_a_crash_between_the_tables_is_mended(spark, tmp_path, monkeypatch):
    """a match goes to another person, and the batch fails when one table is written: the old person's log goes too."""
    seen = spark.createDataFrame([(1, 1)], "image_id long, item_id long")
    items = spark.createDataFrame([(1, 2.0)], "item_id long, calories double")
    logs = DailyLogs(spark, str(tmp_path), seen, items, ["calories"])
    row = lambda person, version: spark.createDataFrame([(1, 1, person, date(2024, 1, 1), "matched", version)], COLUMNS)
    logs.apply(row(1, 0))
    write, calls = streaming_logs.replace_partitions, []

    def fails_once(*args):
        calls.append(args)
        if len(calls) == 2:
            raise OSError("disk")
        write(*args)

    monkeypatch.setattr(streaming_logs, "replace_partitions", fails_once)
    with pytest.raises(OSError):
        logs.apply(row(2, 1))
    logs.apply(row(2, 1))
    assert [(r["student_id"], r["meal_count"], r["items"]) for r in logs.logs().collect()] == [(2, 1, [1])]


def test_recognitions_are_joined_without_a_sort(spark):
    """matches are hashed; groups without matches get a row, those without a person keep no items."""
    day = date(2024, 1, 1)
    matches = spark.createDataFrame([(1, 1, 1, day), (2, 1, 1, day), (3, None, 2, day), (4, 1, None, day)], "match_id long, image_id long, student_id long, log_date date")
    seen = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, 9), (None, 1)], "image_id long, item_id long")
    items = spark.createDataFrame([(1, 2.0), (2, 5.0)], "item_id long, calories double")
    groups = spark.createDataFrame([(1, day), (3, day)], "student_id long, log_date date")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = daily_log(matches, seen, items, ["calories"], ["student_id", "log_date"], groups=groups)
        rows = {r["student_id"]: (r["meal_count"], r["calories"], r["items"]) for r in out.collect()}
        assert "ShuffledHashJoin" in out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows == {1: (2, 18.0, [1, 2]), 2: (1, 0.0, []), 3: (0, 0.0, []), None: (1, 0.0, [])}
