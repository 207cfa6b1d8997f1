"""Percentiles and pages against sorting everything."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.operators import aggregates, paging, quantiles


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_quantiles_of_all_kinds_of_groups(spark, accuracy):
    rng = random.Random(2)
    groups = {
        "normal": [rng.gauss(0, 1) for _ in range(3000)], "steep": [rng.paretovariate(0.3) for _ in range(2000)], "one": [4.0], "two": [1.0, 2.0],
        "same": [7.0] * 1500, "mostly": [5.0] * 900 + [float(i) for i in range(300)], "nulls": [None, 3.0, None, 9.0], "none": [None, None], None: [1.0, 5.0, 6.0],
    }
    rows = [(k, x, "own") for k, v in groups.items() for x in v]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, x double, share string").repartition(7)
    asked = {"low": 0.0, "p1": 0.01, "p50": 0.5, "p90": 0.9, "high": 1.0}
    found = {r["k"]: r for r in quantiles.exact_quantiles(df, ["k"], "x", asked, accuracy).collect()}
    assert set(found) == set(groups)
    for k, v in groups.items():
        v = [x for x in v if x is not None]
        for c, q in asked.items():
            assert found[k][c] == (pytest.approx(float(np.quantile(v, q)), rel=1e-12) if v else None)
    whole = [x for v in groups.values() for x in v if x is not None]
    assert quantiles.exact_quantiles(df, [], "x", {"m": 0.5}).first()["m"] == pytest.approx(float(np.median(whole)), rel=1e-12)
    assert quantiles.exact_quantiles(df.limit(0), ["k"], "x", {"m": 0.5}).count() == 0


def test_no_task_holds_a_hot_group(spark):
    df = spark.range(200_000).select(F.lit(1).alias("k"), (F.xxhash64("id") % 1_000_003).cast("double").alias("x"))
    found = aggregates.baselines(df, ["k"], "x", "p", 0.37)
    assert found.first()["p"] == pytest.approx(df.agg(F.percentile("x", 0.37)).first()[0], rel=1e-12)


def test_deep_pages_and_seeks(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([None, "a", "b", "c"]), rng.choice([None, 1.5, 2.5])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a string, b double").repartition(5)
    for order in ([("a", True), ("b", False), ("id", True)], [("a", False), ("id", False)], [("id", True)]):
        whole = [tuple(r) for r in df.orderBy(*quantiles.sorted_by(order)).collect()]
        for number, size in ((1, 7), (30, 20), (31, 20), (13, 45), (99, 10)):
            page = quantiles.deep_page(df, order, number, size)
            assert [tuple(r) for r in page.collect()] == whole[(number - 1) * size : number * size]
            assert [tuple(r) for r in paging.page(df, quantiles.sorted_by(order), number, size).collect()] == whole[(number - 1) * size : number * size]
        last, seen = None, []
        while page := quantiles.page_after(df, order, last, 97).collect():
            seen += [tuple(r) for r in page]
            last = page[-1].asDict()
        assert seen == whole
    assert quantiles.deep_page(df.limit(0), [("id", True)], 1, 5).count() == 0
    plan = quantiles.deep_page(df, [("id", True)], 3, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan
