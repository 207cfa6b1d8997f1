"""Operators on small tables whose results are known."""

import itertools
import random
import re
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from larder.functions import geometry, numbers, text, times, vectors
from larder.functions.python import even_sample, text_ratio
from larder.operators import assign, filters, joins, merge, nearest, paging, retrieval
from larder.plans import ingest, queries
from larder.sources import files, listings, sinks

NOON = datetime(2024, 1, 5, 12)


def at(seconds):
    return NOON + timedelta(seconds=seconds)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.fixture(scope="module")
def traffic(spark):
    rng = random.Random(7)
    records = [(i, at(rng.randrange(4000) / 4), rng.choice([5.0, 8.0, 8.5, 12.0])) for i in range(150)]
    images = [(i, at(rng.randrange(4000) / 4), rng.choice([5.0, 8.0, 12.0, None])) for i in range(180)]
    return records, images


def frames_of(spark, traffic):
    records, images = traffic
    return (
        spark.createDataFrame(records, "record_id long, record_time timestamp_ntz, amount double"),
        spark.createDataFrame(images, "image_id long, image_time timestamp_ntz, total double"),
    )


def test_nearest_match_against_all_pairs(spark, traffic):
    found = {r["record_id"]: r for r in joins.nearest_match(*frames_of(spark, traffic), seconds=3).collect()}
    for i, t, amount in traffic[0]:
        near = [(abs(amount - (v or 0.0)), abs((t - u).total_seconds()), j) for j, u, v in traffic[1] if abs((t - u).total_seconds()) <= 3]
        best = min(near, default=None)
        status = "unmatched_record" if best is None else "matched" if best[0] <= 0.5 else "time_matched_only"
        assert found[i]["status"] == status and found[i]["image_id"] == (best[2] if best else None)
    assert len(found) == len(traffic[0])


def test_exclusive_match_against_a_loop(spark, traffic):
    found = {r["record_id"]: (r["image_id"], r["status"]) for r in assign.exclusive_match(*frames_of(spark, traffic), seconds=3).collect()}
    free = dict.fromkeys((x[0] for x in traffic[1]), True)
    for i, t, amount in sorted(traffic[0], key=lambda r: (r[1], r[0])):
        near = [(abs(amount - (v or 0.0)), abs((t - u).total_seconds()), j) for j, u, v in traffic[1] if free[j] and abs((t - u).total_seconds()) <= 3]
        best = min(near, default=None)
        if best and best[0] <= 0.5:
            free[best[2]] = False
        expected = (None, "unmatched_record") if best is None else (best[2], "matched" if best[0] <= 0.5 else "time_matched_only")
        assert found[i] == expected


def test_band_ends_and_plan(spark):
    left = spark.createDataFrame([(1, at(0))], "a long, at timestamp_ntz")
    right = spark.createDataFrame([(1, at(1)), (2, at(-1)), (3, at(1.000001))], "b long, bt timestamp_ntz")
    pairs = joins.band_join(left, right, "at", "bt", 1.0)
    assert sorted(r["b"] for r in pairs.collect()) == [1, 2]
    assert "NestedLoop" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_fuzzy_names(spark):
    rows = spark.createDataFrame([("Fried Rice",), ("spicy tofu with rice",), ("noodle soop",), ("zzz",)], "raw_name string")
    names = spark.createDataFrame([(1, "fried-rice"), (2, "spicy tofu"), (3, "noodle soup")], "pos int, name string")
    found = {r["raw_name"]: r["name"] for r in joins.fuzzy_names(rows, names).collect()}
    assert found == {"Fried Rice": "fried-rice", "spicy tofu with rice": "spicy tofu", "noodle soop": "noodle soup", "zzz": None}
    assert spark.range(1).select(text_ratio(F.lit("abcd"), F.lit("bcde"))).first()[0] == 0.75


def plain_fuzzy_name(raw, candidates, least=0.72):
    """candidates: (order, name), in order."""
    key = lambda x: re.sub(r"[\s\u3000·•,，、;；:：（）()【】\[\]{}\-_/]+", "", x.lower())
    k, c = key(raw), [(name, key(name)) for _, name in sorted(candidates)]
    if not k:
        return None
    for name, x in c:
        if x == k:
            return name
    inside = [(SequenceMatcher(None, k, x).ratio(), -len(x), name) for name, x in c if k in x or x in k]
    if inside:
        return max(inside)[2]
    ratio, _, name = max(((SequenceMatcher(None, k, x).ratio(), -i, name) for i, (name, x) in enumerate(c)), default=(0, 0, None))
    return name if ratio >= least else None


@pytest.mark.parametrize("least,empty", [(0.72, False), (0.72, True), (0.6, False), (0.9, False)])
def test_fuzzy_names_against_plain_python(spark, least, empty):
    rng = random.Random(5)
    word = lambda most: "".join(rng.choice("abcd -") for _ in range(rng.randint(1, most)))
    names = sorted({word(m) for m in (5, 8, 14) for _ in range(25)} - {" ", "-"})
    names = [x for x in names if x.strip(" -")] + (["-"] if empty else [])
    rng.shuffle(names)
    raws = sorted({word(m) for m in (2, 6, 10, 16) for _ in range(40)} | {x[:3] + "d" + x[4:] for x in names} | {""})
    c = list(enumerate(names))
    frames = spark.createDataFrame([(x,) for x in raws] + [(None,)], "raw_name string"), spark.createDataFrame(c, "pos int, name string")
    found = {r["raw_name"]: r["name"] for r in joins.fuzzy_names(*frames, least=least).collect()}
    assert found == {x: plain_fuzzy_name(x, c, least) for x in raws} | {None: None}
    assert any(v is None for k, v in found.items() if k) or empty or least < 0.7


def test_fuzzy_name_query_has_all_names_as_candidates(spark, tmp_path):
    parts = [(i, f"{a} {b}") for i, (a, b) in enumerate(itertools.product(["blue", "small", "red", "grey"], [f"thing{n}" for n in range(25)]), 1)] + [(500, "blue thing0"), (501, None)]
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    found = queries.fuzzy_name(spark, str(tmp_path)).collect()
    first = {}
    for i, n in parts:
        if n:
            first.setdefault(n, i)
    c = [(i, n) for n, i in first.items()]
    assert sorted((r["p_partkey"], r["name"]) for r in found) == [(i, n and plain_fuzzy_name(n + " x", c)) for i, n in parts]
    assert all(r["name"] == r["raw_name"][:-2] for r in found if r["raw_name"])


def test_suppressed_keeps_the_surer_box(spark):
    boxes = [(1, 1, "a", 0.91, 5.0, 8.0, 45.0, 42.0), (1, 2, "b", 0.72, 7.0, 10.0, 44.0, 41.0), (1, 3, "c", 0.5, 60.0, 60.0, 90.0, 90.0), (2, 4, "a", 0.9, 0.0, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(boxes, "image_id long, det_id long, name string, confidence double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r["det_id"] for r in assign.suppressed(df).collect()) == [1, 3, 4]


def test_paging(spark):
    assert paging.page_of("x", 5) == paging.page_of(None, None) == (1, 20)
    assert paging.page_of(0, 0) == (1, 1) and paging.page_of(2, 101) == (2, 100)
    df = spark.range(45)
    assert [r["id"] for r in paging.page(df, [F.col("id")], 3, 20).collect()] == list(range(40, 45))
    assert paging.page_counts(df, 3, 20).first().asDict() == {"total": 45, "page": 3, "page_size": 20, "total_pages": 3}
    assert paging.page_counts(df.limit(0), 1, 20).first()["total_pages"] == 0


def test_roster(spark):
    old = spark.createDataFrame([(9, "s1", "old", "c1", None, None, None, "card")], "id long, student_no string, name string, class_id string, class_name string, grade_id string, grade_name string, card_no string")
    new = spark.createDataFrame([(1, "s1", "first", "c1", "", "", "", ""), (2, "s1", "last", "c2", "", "", "", ""), (3, "s2", "", "c1", "", "", "", ""), (4, "s3", "x", " ", "", "", "", "")], "row int, student_no string, name string, class_id string, class_name string, grade_id string, grade_name string, card_no string")
    found = ingest.merged_students(old, new).collect()
    assert [(r["id"], r["student_no"], r["name"], r["class_id"], r["class_name"]) for r in found] == [(9, "s1", "last", "c2", None)]


def payments(spark, *rows):
    return spark.createDataFrame(rows, "`帐号` string, `姓名` string, `交易金额` string, `钱包流水号` string, `交易时间` string, `交易地点` string")


@pytest.mark.parametrize("known, outcome", [([], "imported"), ([("3794", "230502")], "duplicate"), ([("wallet:230502:20260324061220:3794", "230502")], "duplicate"), ([("wallet:230502:3794", "230502")], "duplicate"), ([("3794", "other")], "imported")])
def test_wallet_payments(spark, known, outcome):
    raw = payments(spark, ("230502", "X", "-7", "3794", "2026/03/24 06:12:20\t", "hall 1"))
    existing = spark.createDataFrame([(k, s, datetime(2026, 3, 24, 6, 12, 20)) for k, s in known], "transaction_id string, student_no string, transaction_time timestamp_ntz")
    students = spark.createDataFrame([(1, "230502", None)], "id long, student_no string, card_no string")
    found = ingest.imported_payments(raw, existing, students, "b").first()
    assert found["outcome"] == outcome
    assert (found["transaction_id"], float(found["amount"]), found["student_id"]) == ("wallet:230502:3794", 7.0, 1)


def test_payment_locations(spark):
    raw = payments(spark, ("1", "X", "5", "a", "2026/03/24 06:12:20", "hall 1"), ("1", "X", "5", "b", "2026/03/24 06:12:20", "hall  2"))
    existing = spark.createDataFrame([], "transaction_id string, student_no string, transaction_time timestamp_ntz")
    students = spark.createDataFrame([(1, "1", None)], "id long, student_no string, card_no string")
    found = ingest.imported_payments(raw, existing, students, "b", allowed=["hall 2"])
    assert {r["outcome"]: r[1] for r in ingest.outcomes(found).collect()} == {"imported": 1, "by_location": 1}
    with pytest.raises(ValueError):
        ingest.imported_payments(raw.drop("交易地点"), existing, students, "b", allowed=["hall 2"])


def test_csv_encodings_and_headers(spark, tmp_path):
    (tmp_path / "gbk.csv").write_bytes("学号 ,金额\n1,￥5\n".encode("gb18030"))
    (tmp_path / "utf.csv").write_bytes("﻿学号,金额\n1,5\n".encode())
    for name in ("gbk.csv", "utf.csv"):
        df = files.csv_strings(spark, str(tmp_path / name))
        assert df.columns == ["学号", "金额"] and df.count() == 1
        assert files.suggested_mapping(df.columns) == {"student_id": "学号", "amount": "金额"}


def test_versions_are_whole(spark, tmp_path):
    table = sinks.VersionedTable(spark, str(tmp_path / "index"))
    assert table.read("id long").count() == 0
    table.write(spark.range(3))
    held = table.read()
    table.write(spark.range(5))
    assert (held.count(), table.read().count()) == (3, 5)
    with pytest.raises(Exception):
        table.write(spark.range(1).select(F.raise_error(F.lit("no")).alias("id")))
    assert table.read().count() == 5


def test_an_index_is_written_at_length_one(spark, tmp_path):
    index = sinks.VersionedTable(spark, str(tmp_path / "index"))
    index.write(spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "item_id long, vector array<double>"), vector="vector")
    found = index.read()
    assert found.schema["vector"].dataType.simpleString() == "array<float>"
    assert {r["item_id"]: r["vector"] for r in found.collect()} == {1: pytest.approx([0.6, 0.8], abs=1e-7), 2: [0.0, 0.0], 3: None}


def test_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "days")
    sinks.replace_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "id long, day string"), path, ["day"])
    sinks.replace_partitions(spark.createDataFrame([(3, "b")], "id long, day string"), path, ["day"])
    assert sorted((r["id"], r["day"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]


def test_recordings_of_xml(spark):
    item = "<searchMatchItem><startTime>%s</startTime><endTime>2024-01-05T04:00:10Z</endTime><playbackURI>rtsp://h/?name=n&amp;size=5</playbackURI></searchMatchItem>"
    answer = f'<r xmlns="x">{item % "2024-01-05T12:00:00+08:00"}<searchMatchItem><startTime>s</startTime></searchMatchItem></r>'
    df = spark.createDataFrame([(answer, 3), ("not xml", 3), (None, 3), (f"<r>{item % 'soon'}</r>", 4)], "xml string, channel int")
    found = [tuple(r) for r in listings.recordings(df, channel="channel").collect()]
    assert found == [("cam3_1704427200.mp4", "2024-01-05T12:00:00+08:00", "2024-01-05T04:00:10+00:00", "rtsp://h/?name=n&size=5", 0)]
    assert listings.search_time(datetime(2024, 1, 5, 12), "Asia/Shanghai") == "2024-01-05T04:00:00Z" and listings.track_id(3) == 301
    waits = []
    with pytest.raises(ZeroDivisionError):
        listings.retried(lambda: 1 / 0, sleep=waits.append)
    assert waits == [1.0, 2.0]


@pytest.mark.parametrize("vectors_, threshold, expected", [([[1.0, 0.0], [0.79, 0.0], [0.5, 0.0]], 0.8, [1]), ([[1.0, 0.0], [0.8, 0.0]], 0.8, [1, 2])])
def test_top_k(spark, vectors_, threshold, expected):
    index = spark.createDataFrame([(i + 1, i + 1, v) for i, v in enumerate(vectors_)], "item_id long, label long, vector array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    hits = retrieval.top_k(queries, index, 5, threshold).collect()
    assert sorted(r["item_id"] for r in hits) == expected


def test_functions(spark):
    box = geometry.box(*(F.lit(float(x)) for x in (46, 42, 8, 10)))
    assert tuple(one(spark, box)[0]) == (8.0, 10.0, 46.0, 42.0)
    a, b = (geometry.box(*(F.lit(float(x)) for x in c)) for c in ((0, 0, 2, 2), (1, 1, 3, 3)))
    assert one(spark, geometry.iou(a, b))[0] == pytest.approx(1 / 7)
    assert one(spark, text.squeezed(F.lit(" a　 b\t")), text.masked(F.lit("Xyz")), text.masked(F.lit(None).cast("string"))) == ("a b", "X*", "**")
    assert one(spark, text.filled("{a} {b} {", {"a": F.lit("1")}))[0] == "1 {b} {"
    assert one(spark, text.json_block(F.lit('x ```json\n{"a": 1}\n``` y')), text.json_block(F.lit("none"))) == ('{"a": 1}', None)
    assert float(one(spark, numbers.amount(F.lit("-¥1,234.50")))[0]) == 1234.5 and one(spark, numbers.amount(F.lit("x")))[0] is None
    assert one(spark, times.parsed_time(F.lit("2026/03/24 06:12")))[0] == datetime(2026, 3, 24, 6, 12)
    assert one(spark, F.transform(vectors.normalised(F.array(F.lit(3.0), F.lit(4.0))), lambda x: F.round(x, 6)))[0] == [0.6, 0.8]
    assert even_sample(3, 5) == [0, 1, 2] and even_sample(100, 3)[0] == 0 and even_sample(100, 3)[-1] == 99


def test_filters_and_merge(spark):
    df = spark.createDataFrame([(1, "A_b"), (2, "axb"), (3, None)], "id long, name string")
    assert [r["id"] for r in df.where(filters.same_name("name", "a_B", wildcards=False)).collect()] == [1]
    assert sorted(r["id"] for r in df.where(filters.same_name("name", "a_B")).collect()) == [1, 2]
    assert filters.in_list(df, "id", []).count() == 0 and filters.in_list(df, "id", [1, 3]).count() == 2
    new = spark.createDataFrame([(2, "new"), (4, "four")], "id long, name string")
    assert sorted(tuple(r) for r in merge.upsert(df, new, ["id"]).collect()) == [(1, "A_b"), (2, "new"), (3, None), (4, "four")]


def test_pages_are_fetched_to_the_end():
    def fetch(offset, size):
        return {"items": [{"n": i} for i in range(offset, min(offset + size, 100_001))], "has_more": offset + size < 100_001}

    assert [x["n"] for x in listings.fetch_pages(fetch, 5_000)] == list(range(100_001))
    with pytest.raises(RuntimeError):
        list(listings.fetch_pages(lambda o, n: {"items": [], "has_more": True}))


def test_top_k_of_odd_vectors(spark):
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0, None]), (4, [0.0, 1.0, 0.0]), (5, [])], "query_id long, vector array<double>")
    index = spark.createDataFrame([(10, "a", [1.0, 0.0]), (11, "b", None), (12, "c", [0.0, 1.0, 0.0]), (13, "d", [None, 1.0])], "item_id long, label string, vector array<double>")
    found = retrieval.top_k(queries, index, 2, 0.5)
    assert sorted((r["query_id"], r["item_id"], r["similarity"]) for r in found.collect()) == [(1, 10, 1.0), (4, 12, 1.0)]
    assert retrieval.top_k(queries.limit(0), index).count() == 0


def test_images_are_recognised_from_region_to_label(spark):
    images = spark.createDataFrame([(1, b"\x01\x00"), (2, b"\x00\x01"), (3, b"\x02\x00")], "image_id long, data binary")
    regions = spark.createDataFrame([(1, 1, b"\x00\x01"), (1, 2, b"\x00\x02"), (1, 3, b"\x01\x00")], "image_id long, region int, data binary")
    index = spark.createDataFrame([(10, "x", [1.0, 0.0]), (11, "y", [0.0, 1.0])], "item_id long, label string, vector array<double>")
    embed = lambda data: [float(x) for x in data]
    found = retrieval.recognised(images, regions, index, embed)
    assert sorted((r["image_id"], r["region"], r["label"]) for r in found.collect()) == [(1, 1, "y"), (1, 3, "x"), (2, 0, "y"), (3, 0, "x")]
    scored = retrieval.recognised(images, regions, index, embed, lambda q, i: F.when(i == 11, 0.9).otherwise(0.1))
    assert sorted((r["image_id"], r["label"], r["confidence"]) for r in scored.collect()) == [(1, "y", 0.9), (2, "y", 0.9)]


def plain_suppressed(boxes, overlap=0.6):
    """Best first; the smaller id of equals; a name stays once; boxes that overlap a kept one go."""
    kept = []
    for b in sorted(boxes, key=lambda b: (-b["confidence"], b["det_id"])):
        def alike(k):
            w, h = min(b["x2"], k["x2"]) - max(b["x1"], k["x1"]), min(b["y2"], k["y2"]) - max(b["y1"], k["y1"])
            cut = max(w, 0) * max(h, 0)
            whole = (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) + (k["x2"] - k["x1"]) * (k["y2"] - k["y1"]) - cut
            return whole > 0 and cut / whole >= overlap
        if all(k["name"] != b["name"] and not alike(k) for k in kept):
            kept.append(b)
    return [k["det_id"] for k in kept]


def test_nms_query_against_plain_python(spark, sf_dir):
    from larder.plans.queries import QUERIES

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").collect()
    images = {}
    for r in lines:
        images.setdefault(r["l_orderkey"], []).append({
            "det_id": r["l_linenumber"], "name": r["l_partkey"] % 7, "confidence": round(r["l_discount"] + r["l_tax"], 4),
            "x1": r["l_quantity"] % 10, "y1": r["l_suppkey"] % 10, "x2": r["l_quantity"] % 10 + 12, "y2": r["l_suppkey"] % 10 + 12,
        })
    # where ids of an image repeat, what comes first isn't settled
    clear = {i for i, boxes in images.items() if len({b["det_id"] for b in boxes}) == len(boxes)}
    found = {}
    for r in QUERIES["nms"](spark, sf_dir).collect():
        found.setdefault(r["image_id"], set()).add(r["det_id"])
    assert len(clear) > 50
    for i in clear:
        assert found[i] == set(plain_suppressed(images[i])), i


def test_greedy_query_against_a_loop(spark, sf_dir):
    from larder.plans.queries import QUERIES

    events = sorted((r for r in spark.read.parquet(f"{sf_dir}/events.parquet").collect()), key=lambda r: (r["ts"], r["event_id"]))
    gone, want = set(), {}
    for r in (x for x in events if x["event_type"] == "purchase"):
        near = [
            (abs(r["value"] - i["value"]), abs((r["ts"] - i["ts"]).total_seconds()), i["event_id"])
            for i in events
            if i["event_type"] == "view" and i["user_id"] == r["user_id"] and i["event_id"] not in gone and abs((r["ts"] - i["ts"]).total_seconds()) <= 300
        ]
        best = min(near, default=None)
        want[r["event_id"]] = (best and best[2], "unmatched_record" if not best else "matched" if best[0] <= 5 else "time_matched_only")
        if best and best[0] <= 5:
            gone.add(best[2])
    found = {r["record_id"]: (r["image_id"], r["status"]) for r in QUERIES["greedy_assign"](spark, sf_dir).collect()}
    assert {k: (None if v[0] is None or v[0] != v[0] else int(v[0]), v[1]) for k, v in found.items()} == want


def test_rows_without_an_id_are_no_duplicates_of_one_another(spark):
    raw = payments(spark, *(("1", "X", "-1", n, "2026/03/24 06:12:20", "hall 1") for n in ("", "", "9", "9")))
    empty = lambda s: spark.createDataFrame([], s)
    out = ingest.imported_payments(raw, empty("transaction_id string, student_no string"), empty("id int, student_no string, card_no string"), "b")
    assert sorted(r["outcome"] for r in out.collect()) == ["duplicate", "imported", "missing", "missing"]


@pytest.mark.parametrize("length, most", [(10**6, 50), (3, 6), (0, 2)])
def test_long_spans_stand_in_few_nodes(spark, length, most):
    spans = spark.createDataFrame([(7, -5, -5 + length)], "idx long, a long, b long")
    nodes = joins.spans_indexed(spans, "a", "b", "idx", 1, []).collect()
    assert len(nodes) <= most
    cells = [(n["node"] << n["level"], (n["node"] + 1 << n["level"]) - 1) for n in sorted(nodes, key=lambda n: n["node"] << n["level"])]
    assert cells[0][0] == -5 and cells[-1][1] == -5 + length and all(a[1] + 1 == b[0] for a, b in zip(cells, cells[1:]))


def test_points_in_spans_of_all_lengths(spark):
    rng = random.Random(3)
    spans = [(i, k, a := rng.randrange(-5000, 5000), a + rng.choice([0, 3, 40, 900, 9000, -1])) for i, k in enumerate(rng.choices("ab", k=300))]
    points = [(i, k, rng.randrange(-6000, 12000)) for i, k in enumerate(rng.choices("abc", k=400))] + [(5, "a", 7), (5, "a", 7), (900, None, 7), (901, "a", None)]
    found = joins.within_interval(spark.createDataFrame(points, "id long, k string, at long"), spark.createDataFrame(spans, "idx long, k string, a long, b long"), "at", "a", "b", "idx", 16, ["k"])
    want = [(i, k, t, min((x for x, l, a, b in spans if l == k and t is not None and a <= t <= b), default=None)) for i, k, t in points]
    key = lambda r: tuple((x is None, x or 0 if not isinstance(x, str) else x) for x in r)
    assert sorted((tuple(r) for r in found.select("id", "k", "at", "idx").collect()), key=key) == sorted(want, key=key)


def test_nearest_of_crowded_bands(spark):
    """Buckets dealt into slices, many equal prices, null amounts and totals, keys that must agree."""
    rng = random.Random(11)
    records = [(i, rng.choice("ab"), rng.randrange(40) * 250_000, rng.choice([None, 1.0, 2.0, 2.5, 9.0])) for i in range(200)]
    images = [(i, rng.choice("abc"), rng.randrange(40) * 250_000, rng.choice([None, 1.0, 2.0, 3.0])) for i in range(500)]
    r = spark.createDataFrame(records, "id long, k string, at long, value double")
    i = spark.createDataFrame(images, "id long, k string, at long, value double").selectExpr("*", "CAST(NULL AS LONG) AS until_at", "CAST(NULL AS LONG) AS until_id")
    for rows in (7, 65_536):
        found = {x["record"]: (x["price_diff"], x["time_diff"], x["image"]) for x in nearest.nearest_in_band(r, i, 1.5, ["k"], slice_rows=rows).collect()}
        for n, k, t, v in records:
            near = [(abs(v - (w or 0.0)) if v is not None else 0.0, abs(t - u), j) for j, l, u, w in images if l == k and abs(t - u) <= 1_500_000]
            best = min(near, default=None)
            assert found.get(n) == (best if best is None or v is not None else (None, *best[1:]))


@pytest.mark.parametrize("seed, spread", [(1, 300), (2, 8), (3, 1)])
def test_exclusive_match_of_crowds(spark, seed, spread):
    """Many records want the same images: chains of losers, equal times, a hot key."""
    rng = random.Random(seed)
    records = [(i, at(rng.randrange(4 * spread) / 4), rng.choice([1.0, 1.2, 1.4, 5.0])) for i in range(160)]
    images = [(i, at(rng.randrange(4 * spread) / 4), rng.choice([1.0, 1.3, 1.6, 7.0, None])) for i in range(140)]
    found = {r["record_id"]: (r["image_id"], r["status"], r["time_diff"]) for r in assign.exclusive_match(*frames_of(spark, (records, images)), seconds=3).collect()}
    free = dict.fromkeys((x[0] for x in images), True)
    for i, t, amount in sorted(records, key=lambda r: (r[1], r[0])):
        near = [(abs(amount - (v or 0.0)), abs((t - u).total_seconds()), j) for j, u, v in images if free[j] and abs((t - u).total_seconds()) <= 3]
        best = min(near, default=None)
        if best and best[0] <= 0.5:
            free[best[2]] = False
        assert found[i] == ((None, "unmatched_record", None) if best is None else (best[2], "matched" if best[0] <= 0.5 else "time_matched_only", best[1]))


def test_a_hot_key_of_many_points(spark):
    """1e5 points of one key: nothing is folded in one group."""
    n = 50_000
    r = spark.range(n).select(F.col("id").alias("record_id"), F.timestamp_micros(F.col("id") * 26_000_000).alias("record_time"), (F.col("id") * 37 % 1000 / 10).alias("amount"), F.lit(1).alias("user_id"))
    i = spark.range(n).select(F.col("id").alias("image_id"), F.timestamp_micros(F.col("id") * 26_000_000 + 5_000_000).alias("image_time"), (F.col("id") * 91 % 1000 / 10).alias("total"), F.lit(1).alias("user_id"))
    found = assign.exclusive_match(r, i, 300, 5.0, by=["user_id"]).where("status = 'matched'")
    assert found.count() == found.select("image_id").distinct().count() > n // 2


def test_blank_names_are_inside_all(spark):
    names = lambda x: spark.createDataFrame(list(enumerate(x)), "pos int, name string")
    raws = lambda x: spark.createDataFrame([(v,) for v in x], "raw string")
    find = lambda a, b: {r["raw"]: r["name"] for r in joins.contained_names(raws(a), names(b), "raw", "name", "pos").collect()}
    assert find(["rice bowl", " ", None], ["soup", "rice"]) == {"rice bowl": "rice", " ": "soup"}
    assert find(["rice bowl", "tea"], ["soup", "", "rice"]) == {"rice bowl": ""}
    assert find([" "], []) == {}


@pytest.mark.parametrize("threshold, options", [(0.4, {}), (0.4, {"cell_items": 20, "block_queries": 9, "block_items": 16}), (-0.5, {"cell_items": 50}), (0.95, {"cell_items": 10})])
def test_top_k_grid_against_all_pairs(spark, threshold, options):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(6)]
    vector = lambda: [round(c + rng.gauss(0, 0.2), 2) for c in rng.choice(centres)]
    items = [(i, rng.randrange(3), vector()) for i in range(150)]
    items += [(i, 1, items[0][2]) for i in range(200, 260)] + [(300, 0, [1.0, 2.0]), (301, 1, [0.0] * 5)]
    asks = [(i, vector(), rng.choice([None, [], [1], [0, 2]])) for i in range(60)] + [(70, items[0][2], None), (71, [2.0, 4.0], None)]
    found = retrieval.top_k(
        spark.createDataFrame(asks, "query_id long, vector array<double>, candidate_ids array<int>"), spark.createDataFrame(items, "item_id long, label int, vector array<double>"), 4, threshold, candidates=True, **options
    ).collect()
    for q, v, some in asks:
        n = sum(x * x for x in v) ** 0.5
        near = sorted((-round(sum(a * b for a, b in zip(v, w)) / n, 9), i) for i, label, w in items if len(v) == len(w) and (not some or label in some))
        want = [(-s, i) for s, i in near if -s >= threshold][:4]
        got = sorted(((round(r["similarity"], 9), r["item_id"]) for r in found if r["query_id"] == q), key=lambda x: (-x[0], x[1]))
        assert got == want
