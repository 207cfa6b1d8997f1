"""Reports, sinks and small helpers on hand-made rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from larder.operators import aggregates
from larder.plans import meals
from larder.schemas import NUTRIENTS, RECOMMENDED
from larder.sources import listings, sinks
from larder.streaming.events import due

DAY = dt.date(2024, 3, 4)
DAILY = "student_id long, log_date date, meal_count long, items array<long>, " + ", ".join(f"{n} double" for n in NUTRIENTS)


def eaten(student, day, share, items, meals_=1):
    return (student, DAY + dt.timedelta(day), meals_, items, *(RECOMMENDED[n] * share for n in NUTRIENTS))


@pytest.fixture(scope="module")
def reports(spark):
    people = spark.createDataFrame([(1, "Ann Lee"), (2, "Bo"), (3, "Cy")], "student_id long, name string")
    daily = spark.createDataFrame(
        [eaten(1, d, 1.0, [10]) for d in range(4)]
        + [eaten(2, d, 0.5, [10, 11]) for d in range(3)]
        + [eaten(2, 9, 5.0, [11])]  # after the period
        + [eaten(2, 3, 9.0, [11], meals_=0)],  # no meal
        DAILY,
    )
    dishes = spark.createDataFrame([(10, "rice"), (11, "soup")], "id long, name string")
    return meals.personal_reports(people, daily, dishes, DAY, DAY + dt.timedelta(6))


def test_personal_reports(reports):
    found = {r["student_id"]: r for r in reports.collect()}
    assert {s: r["meal_days"] for s, r in found.items()} == {1: 4, 2: 3, 3: 0}
    assert {s: r["score"] for s, r in found.items()} == {1: 100, 2: 50, 3: 0}
    assert found[1]["summary"] == "Ann Lee本期就餐4/7天，综合评分100分" and not found[1]["alerts"]
    assert found[2]["alerts"][0]["message"] == "calories摄入不足（仅达到推荐量的50%）"
    assert found[2]["summary"] == "Bo本期就餐3/7天，综合评分50分，calories摄入不足（仅达到推荐量的50%）"
    assert [a["nutrient"] for a in found[2]["alerts"]] == NUTRIENTS
    assert [(t["name"], t["count"]) for t in found[2]["top_dishes"]] == [("rice", 3), ("soup", 3)]
    assert found[1]["suggestions"] == [meals.PERIOD_ADVICE_NONE] and len(found[2]["suggestions"]) == 3
    # a person without meals has no days, so no alerts, and means of 0
    assert found[3]["summary"] == "Cy本期就餐0/7天，综合评分0分" and found[3]["calories"] == 0


def test_class_reports_mask_those_flagged(spark, reports):
    people = spark.createDataFrame([(1, "Ann", 7, True), (2, "Bo", 7, True), (3, "Cy", 7, False)], "student_id long, name string, class_id long, is_active boolean")
    (row,) = meals.class_reports(people, reports).collect()
    assert (row["class_id"], row["student_count"], row["class_avg_score"], row["calories"]) == (7, 2, 75, 1500.0)
    (flagged,) = row["flagged_students"]
    assert flagged["student_id"] == 2 and flagged["name_masked"].startswith("B") and flagged["name_masked"] != "Bo"
    assert flagged["score"] == 50 and len(flagged["types"]) == len(flagged["alerts"]) == len(NUTRIENTS)


def test_texts_of_reports(spark):
    one = spark.range(1)
    said = lambda c: one.select(c).first()[0]
    assert said(meals.alert_message(F.lit("fat"), F.lit("excess"), F.lit(1.999))) == "fat摄入超标（达到推荐量的199%）"
    assert said(meals.class_summary(F.lit(7), F.lit(DAY), F.lit(DAY))) == "班级 7 营养报告 2024-03-04 - 2024-03-04"
    heading = meals.push_heading(F.lit("Bo"), F.lit("3"), F.array(F.lit("x"), F.lit("y")))
    assert tuple(said(heading)) == ("[周报] Bo 本周营养摄入分析", "x")
    heading = meals.push_heading(F.lit(None).cast("string"), F.lit("3"), F.array().cast("array<string>"))
    assert tuple(said(heading)) == ("[报告] 3", "营养摄入均衡，请继续保持")
    assert said(meals.push_summary(F.lit(DAY), F.lit(DAY), F.lit(75))) == "2024-03-04 至 2024-03-04 | 综合评分：75分"


def test_push_log(spark):
    users = spark.createDataFrame(
        [(1, "parent", True, [5], None), (2, "teacher", True, None, [9]), (3, "student", True, [5], [9]), (4, "parent", True, [6, 6], None), (5, "parent", False, [7], None)],
        "user_id long, role string, is_active boolean, student_ids array<long>, managed_class_ids array<long>",
    )
    reports = spark.createDataFrame([(1, 5, 9), (2, 6, 8), (3, 7, 8)], "report_id long, student_id long, class_id long")
    deliveries = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 9, True)], "report_id long, user_id long, ok boolean")
    found = {r["report_id"]: tuple(r)[1:] for r in meals.push_log(reports, users, deliveries).collect()}
    # a delivery that isn't known counts as failed; one to somebody who isn't a recipient doesn't count
    assert found == {1: (1, 1, "partial"), 2: (0, 1, "failed"), 3: (0, 0, "sent")}


def test_push_status_of_all_kinds(spark):
    got = spark.createDataFrame([(0, 0), (2, 0), (0, 2), (1, 1)], "s long, f long").select(aggregates.push_status(F.col("s"), F.col("f"))).collect()
    assert [r[0] for r in got] == ["sent", "sent", "failed", "partial"]


def test_event_records_are_appended(spark, tmp_path):
    fields = "timestamp string, image_path string, candidate_frame_count long, best_score double, frame_no long, peak_frame_no long, diff_score double, low_quality boolean, quality_note string, _own long"
    events = spark.createDataFrame([("t", "a.jpg", 3, 0.12345678, 7, 6, 1.00000049, False, "", 1)], fields)
    for _ in range(2):
        sinks.append_events(events, str(tmp_path / "events"))
    lines = [json.loads(x) for p in (tmp_path / "events").glob("part-*") for x in p.read_text().splitlines()]
    assert len(lines) == 2 and list(lines[0]) == sinks.EVENT_FIELDS
    assert (lines[0]["best_score"], lines[0]["diff_score"]) == (0.123457, 1.0)
    assert events.select(*sinks.public_columns(events)).columns == sinks.EVENT_FIELDS


def test_image_names(spark):
    at = [dt.datetime(2024, 3, 4, 5, 6, 7, 1000 * ms) for ms in (10, 250)] + [dt.datetime(2024, 3, 4, 5, 6, 8)]
    events = spark.createDataFrame([("c", t, n) for n, t in enumerate(at)], "channel_id string, captured_at timestamp, frame_no long")
    names = [r["image_name"] for r in sinks.image_names(events).orderBy("frame_no").collect()]
    assert names == ["c_2024-03-04-05-06-07.jpg", "c_2024-03-04-05-06-07-250.jpg", "c_2024-03-04-05-06-08.jpg"]


def test_channels_of_streams(spark):
    rows = [("101", 2), ("102", 1), ("7", 3), (" 7 ", 4), ("", 5), (None, 6), ("a01", 7), ("1001", 8)]
    streams = spark.createDataFrame(rows, "stream_id string, pos long")
    first = listings.channels(streams).orderBy(*listings.numeric_first("channel_id")).collect()
    assert [(r["channel_id"], r["pos"]) for r in first] == [("1", 1), ("7", 3), ("10", 8), ("a", 7)]
    last = listings.last_channels(streams.withColumnRenamed("stream_id", "channel_id")).collect()
    assert {r["channel_id"]: r["pos"] for r in last} == {"101": 2, "102": 1, "7": 4, "a01": 7, "1001": 8}
    names = streams.select(listings.channel_name(F.lit("1"), F.lit(" ")), listings.channel_name(F.lit("7"), F.lit(" x ")), listings.channel_name(F.lit("7"), F.lit(None))).first()
    assert tuple(names) == ("主通道", "x", "通道 7")


def test_source_in_use(spark):
    rows = [(1, True, "enabled", 5), (2, True, "enabled", 6), (3, True, "disabled", 9), (4, False, "enabled", 9), (5, True, "enabled", 6)]
    sources = spark.createDataFrame(rows, "id long, is_active boolean, status string, updated_at long")
    assert [r["id"] for r in listings.active_source(sources).collect()] == [5]
    assert listings.active_source(sources.where("id in (3, 4)")).count() == 0


@pytest.mark.parametrize("hour, found", [(12, []), (13, ["b", "c"])])
def test_sources_that_are_due(spark, hour, found):
    """21:30 in a zone eight hours ahead is 13:30; a task that failed, or of another day, doesn't count."""
    sources = spark.createDataFrame([("a",), ("b",), ("c",)], "source_id string")
    tasks = spark.createDataFrame([("a", DAY, "running"), ("b", DAY, "failed"), ("c", DAY - dt.timedelta(1), "success")], "source_id string, task_date date, status string")
    got = due(sources, tasks, dt.datetime(2024, 3, 4, hour, 30), "21:30", "Asia/Shanghai").collect()
    assert sorted(r["source_id"] for r in got) == found


def test_rate_limit_waits_for_the_oldest_call():
    now, waits = [0.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    gate = listings.RateLimit(2, 1.0, clock=lambda: now[0], sleep=sleep)
    for step in (0.0, 0.25, 0.25, 0.0):
        now[0] += step
        gate.wait()
    assert waits == [0.5, 0.25]


def test_only_one():
    assert listings.only_one(id=None, path="x", file="") == ("path", "x")
    for given in ({"id": 1, "path": "x"}, {"id": None, "path": ""}):
        with pytest.raises(ValueError):
            listings.only_one(**given)
