"""What reviewers found on larger tables, each in small."""

from __future__ import annotations

import random
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pytest

from larder.operators import aggregates, assign, joins, retrieval, windows
from larder.plans import meals
from larder.sources.scratch import Scratch, small


def test_means_of_decimals_are_rounded_as_doubles(spark):
    """122.85 / 3 is a little less than 40.95 as a double, which is what SQL rounds."""
    days = spark.createDataFrame([(1, 1, Decimal(x)) for x in ("3.4300", "7.4900", "111.9300")], "user_id long, meal_count int, total decimal(28,4)")
    found = aggregates.period_averages(days, days.select("user_id").distinct(), "user_id", ["total"]).first()
    assert (found["meal_days"], found["total"]) == (3, 40.9)


def test_frames_of_equal_scores_rank_as_the_logarithms_of_sql_say(spark):
    """Frames 3 and 4 have equal scores but for the last bit."""
    lines = [(21.0, 77858.28, 635, 0.06, 0.08), (7.0, 64134.37, 439, 0.0, 0.03), (2.0, 22801.36, 897, 0.04, 0.1), (30.0, 84009.62, 387, 0.02, 0.02), (9.0, 66510.11, 161, 0.04, 0.03)]
    rows = [(1, n, a, b, float(c % 17), h, k, 0.0, 0.0) for n, (a, b, c, h, k) in enumerate(lines, 1)]
    columns = "g long, frame_no long, laplacian double, tenengrad double, local_clarity double, high_freq_ratio double, completeness double, edge_touch_ratio double, center_distance_ratio double"
    found = {r["frame_no"]: r["rank"] for r in windows.ranked_frames(spark.createDataFrame(rows, columns), ["g"]).collect()}
    assert (found[4], found[3]) == (2, 3)


@pytest.mark.parametrize("by_lot", [False, True])
def test_push_log_counts_recipients_without_listing_them(spark, by_lot):
    """Parents who teach too, repeated children and classes, inactive users, and deliveries to strangers; in lots, a
    class of 3,000 reports and 3,000 teachers has 9,000,000 recipients."""
    rng, n = random.Random(3), 3000 if by_lot else 60
    reports = [(i, rng.choice([i % 50, None]), rng.choice([0, 0, 0, 1, None]), i % 3) for i in range(n)]
    users = [(i, role, rng.random() < 0.8, [rng.randrange(50) for _ in range(4)], [0, rng.choice([0, 1])], i % 4) for i in range(n) for role in rng.choice([["parent"], ["teacher"], ["parent", "teacher"]])]
    ok = {(a, b): rng.choice([True, False, None]) for a in range(3) for b in range(4) if (a, b) != (1, 1)}
    told = [(r, u, rng.choice([True, False, None])) for r in range(n) for u in rng.sample(range(n), 20)] if not by_lot else [(a, b, v) for (a, b), v in ok.items()]
    log = dict()
    for r, u, v in told if not by_lot else []:
        log[r, u] = v
    parents, teachers, want = {}, {}, {}
    for u, role, active, students, classes, _ in users:
        for x in (students if role == "parent" else classes) if active else []:
            (parents if role == "parent" else teachers).setdefault(x, set()).add(u)
    for r, student, class_, lot in reports:
        to = parents.get(student, set()) | teachers.get(class_, set())
        sent = sum(bool(ok.get((lot, u % 4)) if by_lot else log.get((r, u))) for u in to)
        want[r] = (sent, len(to) - sent, "sent" if sent == len(to) else "failed" if not sent else "partial")
    r = spark.createDataFrame(reports, "report_id long, student_id long, class_id long, report_lot long")
    u = spark.createDataFrame(users, "user_id long, role string, is_active boolean, student_ids array<long>, managed_class_ids array<long>, user_lot long")
    d = spark.createDataFrame(told, "report_lot long, user_lot long, ok boolean" if by_lot else "report_id long, user_id long, ok boolean")
    assert {x["report_id"]: tuple(x)[1:] for x in meals.push_log(r, u, d).collect()} == want


@pytest.mark.parametrize("seconds", [0, 0.5, 3])
def test_images_without_a_record_near_them(spark, seconds):
    rng, start = random.Random(seconds), datetime(2024, 1, 1)
    at = lambda most: start + timedelta(microseconds=250_000 * rng.randrange(most) + rng.choice([0, 0, 1, -1]))
    images = [(rng.choice([i, i // 2, None]), rng.choice([at(4000), at(4000), None])) for i in range(600)]
    records = [(rng.choice([at(4000), None]),) for _ in range(120)]
    near = lambda t: any(t and r and abs(t - r) <= timedelta(seconds=seconds) for (r,) in records)
    gone = {i for i, t in images if i is not None and near(t)}
    want = sorted(str((i, t)) for i, t in images if i not in gone)
    found = joins.without_near(spark.createDataFrame(images, "image_id long, image_time timestamp"), spark.createDataFrame(records, "record_time timestamp"), "image_time", "record_time", seconds)
    assert sorted(str(tuple(r)) for r in found.collect()) == want


def test_images_in_a_crowd_are_found_without_pairs(spark):
    """300,000 images and 300,000 records within two seconds, 90,000,000,000 pairs."""
    images = spark.range(300_000).selectExpr("id AS image_id", "timestamp_micros(id * 7 + 1) AS image_time")
    records = spark.range(300_000).selectExpr("timestamp_micros(id * 7 + 3) AS record_time")
    late = spark.sql("SELECT -1L AS image_id, timestamp_micros(999000000) AS image_time")
    assert [tuple(r)[0] for r in joins.without_near(images.unionByName(late), records, "image_time", "record_time", 300).collect()] == [-1]


def test_tables_too_large_to_broadcast_are_shuffled(spark, monkeypatch):
    t = Scratch(spark).put(spark.range(11), "eleven")
    plan = lambda most: spark.range(50).join(small(t, most), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(11) and "Broadcast" not in plan(10)
    start = datetime(2024, 1, 1)
    records = spark.createDataFrame([(i, start + timedelta(seconds=i % 40), float(i % 7)) for i in range(120)], "record_id long, record_time timestamp, amount double")
    images = spark.createDataFrame([(i, start + timedelta(seconds=i % 37), float(i % 5)) for i in range(90)], "image_id long, image_time timestamp, total double")
    of = lambda: sorted(map(str, assign.exclusive_match(records, images, 3).collect()))
    want = of()
    monkeypatch.setattr(assign, "_SENT", 5)
    assert of() == want


def test_equal_vectors_have_equal_similarities_wherever_they_lie(spark):
    rng = np.random.default_rng(1)
    copies, asks = np.repeat(rng.normal(size=(30, 7)), 40, axis=0), rng.normal(size=(53, 7))
    table = pa.table({"asks": [True] * 53 + [False] * 1200, "dim": [7] * 1253, "id": [*range(53), *range(1200)], "label": [0] * 1253, "wanted": pa.array([None] * 1253, pa.list_(pa.int32())), "vector": [*asks.tolist(), *copies.tolist()]})
    found = retrieval._hits(table, 4, -1.0).to_pylist()
    assert len(found) == 4 * 53 and all(sorted(r["item_id"] for r in found if r["query_id"] == q)[0] % 40 == 0 and len({r["similarity"] for r in found if r["query_id"] == q}) == 1 for q in range(53))


def test_cells_that_save_nothing_are_one(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 8)))], "id long, vector array<float>")
    pivots = rng.normal(size=(8, 8)).tolist()
    cells = retrieval._Cells(pivots)
    q, i = cells.assigned(rows, of_length_1=True), cells.assigned(rows)
    pairs, useful = cells.pairs(q, i, 0.1, 1000, 1000)
    assert pairs.count() > 32 and not useful
    assert cells.pairs(q, i, 0.1, 10, 10)[0].count() == pairs.count()


def in_turn(records, images, seconds, most):
    """Records (id, time, amount, key) by time, then id, each with the best image (id, time, total, key) that none before it matched."""
    gone, found = set(), {}
    for i, t, amount, key in sorted((r for r in records if r[1] and r[3]), key=lambda r: (r[1], r[0])):
        near = [(0.0 if amount is None else abs(amount - (v or 0.0)), abs((t - u).total_seconds()), j) for j, u, v, k in images if k == key and u and (key, j) not in gone and abs((t - u).total_seconds()) <= seconds]
        if near:
            price, time, image = min(near)
            taken = amount is not None and price <= most
            found[i] = (image, "matched" if taken else "time_matched_only", time, None if amount is None else price)
            if taken:
                gone.add((key, image))
    return {r[0]: found.get(r[0], (None, "unmatched_record", None, None)) for r in records}


def assigned(spark, records, images, **options):
    r = spark.createDataFrame(records, "record_id long, record_time timestamp, amount double, key string")
    i = spark.createDataFrame(images, "image_id long, image_time timestamp, total double, key string")
    return {x["record_id"]: tuple(x)[1:] for x in assign.exclusive_match(r, i, **options).collect()}


def test_a_chain_of_losers_is_no_chain_of_rounds(spark, monkeypatch):
    """Each record first wants the image that the record before it ends with, a bucket of time earlier."""
    written, put = [], Scratch.put
    monkeypatch.setattr(Scratch, "put", lambda self, df, name: (written.append(name), put(self, df, name))[1])
    start = datetime(2024, 1, 1)
    records = [(n, start + timedelta(seconds=1.8 * n), 5.0, "a") for n in range(12)]
    images = [(n, start + timedelta(seconds=1.8 * n + 0.9), 5.0 + n / 64, "a") for n in range(12)]
    assert assigned(spark, records, images, seconds=1) == {n: (n, "matched", 0.9, n / 64) for n in range(12)}
    assert len(written) <= 20, written


@pytest.mark.parametrize("chunk, crowd", [(1, 65_536), (40, 65_536), (32_768, 65_536), (40, 0), (40, 20)])
def test_chunks_of_time_end_where_one_line_ends(spark, monkeypatch, chunk, crowd):
    """Scarce images, equal times and prices, an id that stands at two times, what has no time, key or amount."""
    monkeypatch.setattr(assign, "_CHUNK", chunk)
    monkeypatch.setattr(assign, "_CROWD", crowd)
    rng, start = random.Random(chunk), datetime(1969, 12, 31, 23, 59, 30)
    time = lambda: start + timedelta(seconds=rng.choice([rng.randrange(60), 20 + rng.randrange(40) / 4]))
    records = [(n, rng.choice([time(), time(), time(), time(), None]), rng.choice([1.0, 1.2, 1.4, 5.0, None]), rng.choice(["a", "a", "a", "b", None])) for n in range(150)]
    images = [(n // 2 if n < 30 else n, rng.choice([time(), time(), time(), None]), rng.choice([1.0, 1.3, 1.6, 7.0, None]), rng.choice(["a", "a", "a", "b", None])) for n in range(130)]
    want, found = in_turn(records, images, 3, 0.5), assigned(spark, records, images, seconds=3, by=["key"])
    assert found == want and {x[1] for x in found.values()} == {"matched", "time_matched_only", "unmatched_record"}
