"""Queries of operators that stay bounded where inputs are dense, long or hot, with SQL where DuckDB can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from larder.operators import assign, retrieval
from larder.operators.paging import top
from larder.operators.quantiles import deep_page, exact_quantiles
from larder.plans import queries as plain
from larder.plans.queries import SQL, _events, _images, _records, query
from larder.sources.files import table
from larder.sources.scratch import shared_folder
from larder.streaming import background


def _one_by_one(by: str) -> str:
    """Payments one after another, each with the best view that none before it matched."""
    return f"""
    WITH RECURSIVE r AS (SELECT event_id AS record_id, {by} AS k, ts AS rt, value AS amount, row_number() OVER (PARTITION BY {by} ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase'),
    i AS (SELECT event_id AS image_id, {by} AS k, ts AS it, value AS total FROM events WHERE event_type = 'view'),
    p AS (SELECT r.record_id, list_sort(list({{'pd': abs(r.amount - i.total), 'td': abs(epoch_us(r.rt) - epoch_us(i.it)) / 1000000.0, 'image_id': i.image_id}})) AS near
          FROM r JOIN i ON r.k = i.k AND i.it BETWEEN r.rt - INTERVAL 300 SECOND AND r.rt + INTERVAL 300 SECOND GROUP BY 1),
    q AS MATERIALIZED (SELECT r.k, r.n, r.record_id, coalesce(p.near, []) AS near FROM r LEFT JOIN p USING (record_id)),
    g AS (SELECT k, 0::BIGINT AS n, []::BIGINT[] AS taken, NULL::BIGINT AS record_id, NULL::STRUCT(pd DOUBLE, td DOUBLE, image_id BIGINT) AS b FROM q GROUP BY k
          UNION ALL
          SELECT k, n, CASE WHEN b.pd <= 5.0 THEN list_append(taken, b.image_id) ELSE taken END, record_id, b
          FROM (SELECT q.k, q.n, q.record_id, g.taken, list_filter(q.near, lambda c: NOT list_contains(g.taken, c.image_id))[1] AS b FROM g JOIN q ON q.k = g.k AND q.n = g.n + 1))
    SELECT record_id, b.image_id AS image_id, CASE WHEN b IS NULL THEN 'unmatched_record' WHEN b.pd <= 5.0 THEN 'matched' ELSE 'time_matched_only' END AS status,
           round(b.td, 6) AS time_diff, round(b.pd, 6) AS price_diff FROM g WHERE record_id IS NOT NULL
    """


SQL["greedy_assign"] = _one_by_one("user_id")


@query(_one_by_one("1"))
def greedy_assign_all(spark, d):
    """J2, all records and images on one line of time."""
    out = assign.exclusive_match(_records(spark, d), _images(spark, d), 300, 5.0)
    return out.withColumns({c: F.round(c, 6) for c in ("time_diff", "price_diff")})


@query()
def background_scan(spark, d):
    """Vectors as frames of 8 by 8, a hundred to a channel; held against a loop over pixels by tests."""
    e = table(spark, d, "embeddings").where("embedding is not null")
    grey = F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(F.least(F.greatest(F.floor(x * 256 + 128), F.lit(0)), F.lit(255))), 2, "0")), "")
    frames = e.select(F.floor(F.col("vec_id") / 100).alias("channel_id"), (F.col("vec_id") % 100).cast("int").alias("frame_no"), F.lit(8).alias("width"), F.unhex(grey).alias("pixels"))
    return background.foreground(frames, view=background.View(history=50, open=1, close=3, least_area=4, least_share=0.1))


@query("""
    WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings),
    p AS (SELECT q.query_id, e.vec_id AS item_id, list_dot_product(q.v, e.embedding::DOUBLE[]) / q.n AS s FROM q, embeddings e WHERE q.query_id <> e.vec_id OR e.vec_id % 2 = 0)
    SELECT query_id, item_id, round(s, 4) AS similarity FROM p WHERE s >= 0.3
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) <= 3
""")
def vector_topk_all(spark, d):
    """V1, L5, with every vector as a query; every second one is no hit of its own."""
    e = table(spark, d, "embeddings")
    queries = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    index = e.select(F.col("vec_id").alias("item_id"), "label", F.col("embedding").alias("vector"))
    hits = retrieval.top_k(queries, index, 4, 0.3).where("query_id <> item_id or item_id % 2 = 0")
    return top(hits, 3, ["query_id"], [F.desc("similarity"), F.col("item_id")]).withColumn("similarity", F.round("similarity", 4))


@query("""
    SELECT l_linestatus, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.999), 4) AS p999,
           round(quantile_cont(l_quantity, 0.25), 4) AS q25 FROM lineitem GROUP BY 1
    UNION ALL SELECT 'all', round(quantile_cont(l_extendedprice, 0.1), 4), round(quantile_cont(l_extendedprice, 0.5), 4), round(quantile_cont(l_extendedprice, 0.999), 4), round(quantile_cont(l_quantity, 0.25), 4) FROM lineitem
""")
def hot_percentiles(spark, d):
    """Percentiles of all line items as one group, and of two large ones."""
    l = table(spark, d, "lineitem").select(F.explode(F.array(F.lit("all"), "l_linestatus")).alias("l_linestatus"), "l_extendedprice", "l_quantity")
    price = exact_quantiles(l, ["l_linestatus"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p999": 0.999})
    out = price.join(exact_quantiles(l, ["l_linestatus"], "l_quantity", {"q25": 0.25}), "l_linestatus")
    return out.select("l_linestatus", *(F.round(c, 4).alias(c) for c in ("p10", "p50", "p999", "q25")))


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem
    QUALIFY row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) BETWEEN (SELECT count(*) // 2 // 20 * 20 + 1 FROM lineitem) AND (SELECT count(*) // 2 // 20 * 20 + 20 FROM lineitem)
""")
def middle_page(spark, d):
    """L1: the page in the middle of all line items, the dearest first. The page is the feature."""
    l = table(spark, d, "lineitem")
    order = [("l_extendedprice", False), *((c, True) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))]
    out = deep_page(l, order, l.count() // 2 // 20 + 1, 20)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


SQL["incremental_logs"] = SQL["daily_log"].replace("FROM orders),", "FROM orders WHERE o_orderkey % 11 <> 0),", 1)


@query(SQL["incremental_logs"])
def incremental_logs(spark, d):
    """Daily logs after three batches of matches, of which the last takes some matches back."""
    from larder.streaming.logs import DailyLogs

    matches, lines, parts = plain._log_inputs(spark, d)
    logs = DailyLogs(spark, f"{shared_folder(spark)}/larder-logs-{uuid.uuid4().hex}", lines, parts, ["quantity", "price"], "o_custkey", "day")
    third = F.col("match_id") % 3
    batch = lambda at, status, version: matches.where(at).withColumns({"status": status, "version": F.lit(version)})
    logs.apply(batch(third == 0, F.lit("matched"), 1), 0)
    logs.apply(batch(third > 0, F.lit("confirmed"), 1), 1)
    logs.apply(batch((F.col("match_id") % 11 == 0) | (F.col("match_id") % 7 == 0), F.when(F.col("match_id") % 11 == 0, "unmatched_record").otherwise("confirmed"), 2), 2)
    out = logs.logs()
    return out.select("o_custkey", F.date_format("day", "yyyy-MM-dd").alias("day"), "meal_count", F.col("quantity").cast("double").alias("quantity"), F.col("price").cast("double").alias("price"), F.array_join("items", ",").alias("items"))
