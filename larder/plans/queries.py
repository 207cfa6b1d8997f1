"""Queries on the driver's tables, each an operator applied, with the same in DuckDB's SQL.

Tables stand in for the domain's: purchases for payments, views for images, line items for recognitions,
parts for dishes, customers for people, nations for classes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions import geometry, numbers, text, times
from larder.functions.vectors import normalised
from larder.operators import aggregates, assign, filters, joins, merge, paging, retrieval, windows
from larder.sources.files import table
from larder.streaming import events as event_machines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, d: str, kind: str | None = None) -> DataFrame:
    e = table(spark, d, "events")
    return e.where(F.col("event_type") == kind) if kind else e


def _records(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, "purchase").select(F.col("event_id").alias("record_id"), F.col("ts").alias("record_time"), F.col("value").alias("amount"))


def _images(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d, "view").select(F.col("event_id").alias("image_id"), F.col("ts").alias("image_time"), F.col("value").alias("total"))


_PAIRS = """
    r AS (SELECT event_id AS record_id, ts AS rt, value AS amount FROM events WHERE event_type = 'purchase'),
    i AS (SELECT event_id AS image_id, ts AS it, value AS total FROM events WHERE event_type = 'view'),
    p AS (SELECT r.record_id, i.image_id, abs(r.amount - i.total) AS price_diff,
                 abs(epoch_us(r.rt) - epoch_us(i.it)) / 1000000.0 AS time_diff
          FROM r JOIN i ON i.it BETWEEN r.rt - INTERVAL 300 SECOND AND r.rt + INTERVAL 300 SECOND)
"""


@query(f"""
    WITH {_PAIRS},
    b AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY price_diff, time_diff, image_id) AS n FROM p)
    SELECT r.record_id, b.image_id,
           CASE WHEN b.image_id IS NULL THEN 'unmatched_record' WHEN b.price_diff <= 5.0 THEN 'matched' ELSE 'time_matched_only' END AS status,
           round(b.time_diff, 6) AS time_diff, round(b.price_diff, 6) AS price_diff
    FROM r LEFT JOIN b ON r.record_id = b.record_id AND b.n = 1
""")
def band_match_best(spark, d):
    """J1, J3."""
    out = joins.nearest_match(_records(spark, d), _images(spark, d), 300, 5.0)
    return out.withColumns({c: F.round(c, 6) for c in ("time_diff", "price_diff")})


@query(f"""
    WITH {_PAIRS},
    b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY price_diff, time_diff, record_id) AS n FROM p)
    SELECT image_id, record_id, round(price_diff, 6) AS price_diff FROM b WHERE n = 1
""")
def band_match_reverse(spark, d):
    """J7."""
    r = _records(spark, d).select(F.col("record_id").alias("image_id"), F.col("record_time").alias("image_time"), F.col("amount").alias("total"))
    i = _images(spark, d).select(F.col("image_id").alias("record_id"), F.col("image_time").alias("record_time"), F.col("total").alias("amount"))
    out = joins.nearest_match(i, r, 300, 5.0).where("image_id is not null")
    return out.select(F.col("record_id").alias("image_id"), F.col("image_id").alias("record_id"), F.round("price_diff", 6).alias("price_diff"))


@query(f"WITH {_PAIRS} SELECT i.image_id FROM i WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.image_id = i.image_id)")
def unmatched_anti(spark, d):
    """J5, J6."""
    return joins.without_near(_images(spark, d), _records(spark, d), "image_time", "record_time", 300).select("image_id")


@query()
def greedy_assign(spark, d):
    """J2, each user's records with the user's own images; its SQL stands in `wide_queries`."""
    of = lambda df, key: df.join(_events(spark, d).select(F.col("event_id").alias(key), "user_id"), key)
    out = assign.exclusive_match(of(_records(spark, d), "record_id"), of(_images(spark, d), "image_id"), 300, 5.0, by=["user_id"])
    return out.withColumns({c: F.round(c, 6) for c in ("time_diff", "price_diff")})


@query("""
    WITH l AS (SELECT l_orderkey, round(sum(l_extendedprice::DECIMAL(18,2)), 2)::DOUBLE AS total FROM lineitem GROUP BY 1)
    SELECT o_orderkey, o_custkey, coalesce(total, 0) AS total, CASE WHEN total IS NULL THEN 'unmatched_record' ELSE 'matched' END AS status
    FROM orders LEFT JOIN l ON o_orderkey = l_orderkey WHERE o_orderdate::DATE >= DATE '1995-03-01'
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20
""")
def match_listing_page(spark, d):
    """The second page of orders with their totals. The page is the feature."""
    totals = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total"))
    o = table(spark, d, "orders").where(F.col("o_orderdate").cast("timestamp") >= F.lit("1995-03-01").cast("timestamp"))
    out = o.join(totals, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        "o_orderkey", "o_custkey", F.coalesce("total", F.lit(0.0)).alias("total"), F.when(F.col("total").isNull(), "unmatched_record").otherwise("matched").alias("status"), "o_orderdate"
    )
    return paging.page(out, [F.desc("o_orderdate"), F.col("o_orderkey")], *paging.page_of("2", "20")).drop("o_orderdate")


@query("SELECT count(*) AS total, 3 AS page, 20 AS page_size, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages FROM orders WHERE o_orderstatus = 'O'")
def page_envelope(spark, d):
    """K17, P4."""
    return paging.page_counts(filters.given(table(spark, d, "orders"), o_orderstatus="O", o_orderpriority=None), 3, 20)


@query("""
    SELECT o_orderkey, coalesce(sum(p_retailprice::DECIMAL(18,2)), 0)::DOUBLE AS price_total
    FROM orders LEFT JOIN (lineitem JOIN part ON l_partkey = p_partkey) ON l_orderkey = o_orderkey GROUP BY 1
""")
def price_rollup(spark, d):
    """J12, A7."""
    facts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("p_partkey"))
    items = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").cast("decimal(18,2)").alias("price"))
    out = joins.lookup_sum(facts, items, "o_orderkey", "p_partkey", "price", "price_total", table(spark, d, "orders"))
    return out.withColumn("price_total", F.col("price_total").cast("double"))


@query("""
    SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS "O", count(*) FILTER (o_orderstatus = 'F') AS "F",
           count(*) FILTER (o_orderstatus = 'P') AS "P" FROM orders GROUP BY 1
""")
def status_summary(spark, d):
    """A2, A27."""
    return aggregates.counts_of(table(spark, d, "orders"), "o_orderstatus", ["O", "F", "P"], by=["o_orderpriority"])


@query("""
    SELECT p_brand, count(*) AS total, count(*) FILTER (l_returnflag = 'A') AS "A", count(*) FILTER (l_returnflag = 'N') AS "N",
           count(*) FILTER (l_returnflag = 'R') AS "R" FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
""")
def sample_stats(spark, d):
    """A3, J11, A29."""
    l = table(spark, d, "lineitem").select("l_partkey", "l_returnflag")
    return aggregates.counts_of(l.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")), "l_returnflag", ["A", "N", "R"], by=["p_brand"])


@query("""
    WITH m AS (SELECT o_custkey, o_orderdate::DATE AS day, o_orderkey FROM orders),
    s AS (SELECT o_custkey, day, sum(l_quantity::DECIMAL(18,2)) AS quantity, sum(l_extendedprice::DECIMAL(18,2)) AS price,
                 list_sort(list(DISTINCT l_partkey)) AS items
          FROM m JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
    SELECT m.o_custkey, strftime(m.day, '%Y-%m-%d') AS day, count(DISTINCT o_orderkey) AS meal_count, coalesce(any_value(quantity), 0)::DOUBLE AS quantity,
           coalesce(any_value(price), 0)::DOUBLE AS price, coalesce(array_to_string(any_value(items), ','), '') AS items
    FROM m LEFT JOIN s ON m.o_custkey = s.o_custkey AND m.day = s.day GROUP BY m.o_custkey, m.day
""")
def daily_log(spark, d):
    """A customer's day."""
    out = aggregates.daily_log(*_log_inputs(spark, d), ["quantity", "price"], ["o_custkey", "day"])
    return out.withColumns({"day": F.date_format("day", "yyyy-MM-dd"), "quantity": F.col("quantity").cast("double"), "price": F.col("price").cast("double"), "items": F.array_join("items", ",")})


def _log_inputs(spark, d):
    money = lambda c: F.col(c).cast("decimal(18,2)")
    m = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("match_id"), F.col("o_orderkey").alias("image_id"))
    # nutrients of a recognition are those of its line; parts only say that the item is known
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("item_id"), money("l_quantity").alias("quantity"), money("l_extendedprice").alias("price"))
    return m, lines, table(spark, d, "part").select(F.col("p_partkey").alias("item_id"))


@query("""
    WITH days AS (SELECT user_id, ts::DATE AS day, count(*) AS n, sum(value::DECIMAL(18,4)) AS total FROM events WHERE event_type <> 'click' GROUP BY 1, 2)
    SELECT user_id, count(*) AS meal_days, round_even(avg(n), 1) AS n, round_even(sum(total) / count(*), 1)::DOUBLE AS total
    FROM days GROUP BY 1
""")
def period_avg(spark, d):
    """Means over days with events."""
    e = _events(spark, d)
    days = e.where("event_type <> 'click'").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    out = aggregates.period_averages(days.withColumn("meal_count", F.col("n")), days.select("user_id").distinct(), "user_id", ["n", "total"])
    return out


@query("""
    WITH a AS (SELECT o_custkey, count(*) AS meal_days, round_even(avg(o_totalprice::DECIMAL(18,2)), 1)::DOUBLE AS price FROM orders GROUP BY 1)
    SELECT o_custkey, 0 AS ordinal, 'price' AS nutrient, CASE WHEN price / 150000.0 < 0.6 THEN 'deficiency' ELSE 'excess' END AS type,
           round_even(price / 150000.0, 2) AS ratio
    FROM a WHERE meal_days >= 3 AND (price / 150000.0 < 0.6 OR price / 150000.0 > 1.5)
""")
def ratio_alerts(spark, d):
    """A11."""
    a = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("meal_days"), numbers.half_even(numbers.mean(F.col("o_totalprice").cast("decimal(18,2)")), 1).alias("price"))
    return aggregates.ratio_alerts(a, "o_custkey", {"price": 150000.0})


@query("""
    WITH c AS (SELECT o_custkey, l_partkey AS item_id, count(DISTINCT o_orderdate::DATE) AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY days DESC, item_id) AS rank FROM c)
    SELECT item_id, o_custkey, days, rank, p_name AS name FROM r JOIN part ON item_id = p_partkey WHERE rank <= 5
""")
def top_items(spark, d):
    """Each customer's five most frequent parts, by days. The five are the feature."""
    o = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderkey")
    lines = o.join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    logs = lines.groupBy("o_custkey", "day").agg(F.collect_set("l_partkey").alias("items"), F.count("*").alias("meal_count"))
    names = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"))
    return aggregates.frequent_items(logs, "o_custkey", names)


@query("""
    WITH o AS (SELECT o_custkey, round_even(avg(o_totalprice::DECIMAL(18,2)), 1)::DOUBLE AS price FROM orders GROUP BY 1)
    SELECT c_nationkey, count(*) AS people, round_even(avg(coalesce(price, 0)), 1) AS price, count(*) FILTER (price > 225000) AS flagged,
           CAST(round_even(avg(round_even(100 - least(100.0, abs(1 - coalesce(price, 0) / 150000.0) * 100), 0)), 0) AS INTEGER) AS score
    FROM customer LEFT JOIN o ON c_custkey = o_custkey GROUP BY 1
""")
def class_rollup(spark, d):
    """Nations as classes; customers without orders count as 0."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(numbers.half_even(numbers.mean(F.col("o_totalprice").cast("decimal(18,2)")), 1).alias("price"))
    people = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.lit(True).alias("is_active"))
    means = people.select("c_custkey").join(o, "c_custkey", "left").withColumn("price", F.coalesce("price", F.lit(0.0)))
    return aggregates.group_report(people, means, o.where("price > 225000"), "c_custkey", "c_nationkey", ["price"], {"price": 150000.0})


@query("""
    WITH logs AS (SELECT user_id, ts::DATE AS day, count(*) FILTER (event_type = 'purchase') AS meals FROM events GROUP BY 1, 2)
    SELECT user_id, count(*) AS logs FROM logs WHERE day >= DATE '2024-01-30' - 5 GROUP BY 1 HAVING count(*) >= 3 AND sum(meals) = 0
""")
def no_activity_alert(spark, d):
    """A14."""
    logs = _events(spark, d).groupBy("user_id", F.to_date("ts").alias("log_date")).agg(F.count_if(F.col("event_type") == "purchase").alias("meal_count"))
    return aggregates.no_meal_alerts(logs, "user_id", "2024-01-30")


@query("""
    SELECT c_custkey, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN ('NATION_3', 'NATION_7') OR n_regionkey = 2 AND n_name LIKE '%1%'
""")
def scoped_rows(spark, d):
    """Rows that a list of classes, or a region and part of a name, allow."""
    n = table(spark, d, "nation")
    allowed = filters.in_list(n, "n_name", ["NATION_3", "NATION_7"]).unionByName(n.where((F.col("n_regionkey") == 2) & filters.contains("1", "n_name"))).distinct()
    return table(spark, d, "customer").join(allowed, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey", "c_name")


@query("""
    WITH u AS (SELECT 1 AS user_id, [3, 7, 11] AS ids UNION ALL SELECT 2, [7, 12] UNION ALL SELECT 3, []::INTEGER[])
    SELECT user_id, c_custkey, c_name FROM (SELECT user_id, unnest(ids) AS k FROM u) JOIN customer ON k = c_custkey
""")
def member_rows(spark, d):
    """J19, P15."""
    users = spark.createDataFrame([(1, [3, 7, 11]), (2, [7, 12]), (3, [])], "user_id int, ids array<int>")
    return joins.members(users, "ids", "k").join(table(spark, d, "customer"), F.col("k") == F.col("c_custkey")).select("user_id", "c_custkey", "c_name")


@query("""
    SELECT w.pos::INTEGER AS pos, p_partkey, p_name FROM (VALUES (44, 0), (7, 1), (1900, 2), (3, 3), (99999999, 4)) AS w(k, pos) JOIN part ON p_partkey = k ORDER BY w.pos
""")
def ordered_in_list(spark, d):
    """J14."""
    return joins.in_given_order(table(spark, d, "part"), [44, 7, 1900, 3, 7, 99999999], "p_partkey").select("pos", "p_partkey", "p_name")


@query("""
    SELECT o_orderkey, coalesce(a.c_custkey, b.c_custkey) AS found_id
    FROM orders LEFT JOIN customer a ON o_custkey = a.c_custkey AND a.c_custkey % 3 = 0 LEFT JOIN customer b ON o_custkey = b.c_custkey + 1
""")
def or_key_lookup(spark, d):
    """A customer by own key, kept for every third, else by the key after it."""
    people = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).alias("no"), (F.col("c_custkey") + 1).alias("card"))
    return joins.either_key(table(spark, d, "orders"), people, "o_custkey", "no", "card", "c_custkey").select("o_orderkey", "found_id")


@query("""
    SELECT s_suppkey, n_nationkey FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'nation_' || (s_suppkey % 30) ELSE 'NATION_' || (s_suppkey % 30) END AS raw FROM supplier)
    LEFT JOIN nation ON lower(raw) = lower(n_name)
""")
def name_lookup(spark, d):
    """J16, P8."""
    prefix = F.when(F.col("s_suppkey") % 2 == 0, "nation_").otherwise("NATION_")
    rows = table(spark, d, "supplier").select("s_suppkey", F.concat(prefix, (F.col("s_suppkey") % 30).cast("string")).alias("raw"))
    return joins.by_name(rows, table(spark, d, "nation"), "raw", "n_name", "n_nationkey").select("s_suppkey", "n_nationkey")


@query("""
    WITH m AS (SELECT n_regionkey, list_sort(list(n_nationkey)) AS ids FROM nation WHERE n_nationkey % 3 = 0 GROUP BY 1),
    a AS (SELECT list_sort(list(n_nationkey)) AS ids FROM nation)
    SELECT r_regionkey, array_to_string(CASE WHEN r_regionkey = 1 THEN a.ids ELSE coalesce(m.ids, a.ids) END, ',') AS ids
    FROM region LEFT JOIN m ON r_regionkey = n_regionkey CROSS JOIN a
""")
def effective_menu(spark, d):
    """A region's own list of nations, else all nations."""
    n = table(spark, d, "nation")
    own = n.where("n_nationkey % 3 = 0 and n_regionkey <> 1").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.create_map(F.lit("lunch"), F.array_sort(F.collect_list("n_nationkey"))).alias("slots"))
    out = joins.effective_list(table(spark, d, "region").select("r_regionkey"), own, "r_regionkey", "lunch", n.select(F.col("n_nationkey").alias("id")))
    return out.select("r_regionkey", F.array_join("ids", ",").alias("ids"))


@query("""
    SELECT slot, count(*) AS n FROM (SELECT CASE
        WHEN ts::TIME BETWEEN TIME '05:00' AND TIME '09:30' THEN 'breakfast' WHEN ts::TIME BETWEEN TIME '10:30' AND TIME '13:30' THEN 'lunch'
        WHEN ts::TIME BETWEEN TIME '17:00' AND TIME '19:30' THEN 'dinner' WHEN ts::TIME BETWEEN TIME '21:00' AND TIME '23:59' THEN 'late_night' END AS slot FROM events) GROUP BY 1
""")
def slot_of_time(spark, d):
    """J21, F9."""
    return _events(spark, d).groupBy(times.meal_slot(F.col("ts").cast("timestamp")).alias("slot")).agg(F.count("*").alias("n"))


_DIRTY = "CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y/%m/%d %H:%M') WHEN 1 THEN 'soon' WHEN 2 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END"


@query(f"""
    WITH s AS (SELECT o_orderkey, {_DIRTY} AS t, CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE '¥-' || o_totalprice END AS a, o_custkey % 5 AS place FROM orders),
    k AS (SELECT *, CASE WHEN t IS NULL THEN 'missing' WHEN t = 'soon' OR a = 'x' THEN 'unparsed' WHEN place NOT IN (1, 2, 3) THEN 'by_location' ELSE 'imported' END AS outcome FROM s)
    SELECT outcome, count(*) AS rows FROM k GROUP BY 1
""")
def import_outcomes(spark, d):
    """Outcomes of an import made of orders."""
    from larder.plans import ingest

    o = table(spark, d, "orders").withColumn("_t", F.col("o_orderdate").cast("timestamp"))
    time = F.when(F.col("o_orderkey") % 7 == 0, F.date_format("_t", "yyyy/MM/dd HH:mm")).when(F.col("o_orderkey") % 7 == 1, "soon").when(F.col("o_orderkey") % 7 == 2, F.lit(None)).otherwise(F.date_format("_t", "yyyy-MM-dd HH:mm:ss"))
    raw = o.select(
        F.col("o_custkey").cast("string").alias("card_no"), F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("serial_no"), time.alias("Time"),
        F.when(F.col("o_orderkey") % 11 == 0, "x").otherwise(F.concat(F.lit("¥-"), F.col("o_totalprice").cast("string"))).alias("price"),
        F.concat(F.lit(" hall  "), (F.col("o_custkey") % 5).cast("string")).alias("transaction_location"),
    )
    existing = spark.createDataFrame([], "transaction_id string, student_no string")
    people = spark.createDataFrame([], "id int, student_no string, card_no string")
    return ingest.outcomes(ingest.imported_payments(raw, existing, people, "b1", allowed=["hall 1", "hall 2", "hall 3"]))


@query("""
    WITH a AS (SELECT * FROM customer WHERE c_custkey % 2 = 0), b AS (SELECT c_custkey, c_acctbal + 1 AS c_acctbal, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'NEW' END AS c_mktsegment FROM customer WHERE c_custkey % 3 = 0)
    SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NOT NULL THEN b.c_acctbal ELSE a.c_acctbal END AS c_acctbal,
           coalesce(nullif(b.c_mktsegment, ''), a.c_mktsegment) AS c_mktsegment
    FROM a FULL JOIN b ON a.c_custkey = b.c_custkey
""")
def upsert_latest(spark, d):
    """K2, K5."""
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    new = c.where("c_custkey % 3 = 0").select("c_custkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise("NEW").alias("c_mktsegment"))
    return merge.coalesced(c.where("c_custkey % 2 = 0"), new, F.col("c_custkey"), F.col("c_custkey"), ["c_acctbal"], ["c_mktsegment"], ["c_custkey"])


@query("""
    WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings WHERE vec_id % 50 = 0),
    p AS (SELECT q.query_id, e.vec_id AS item_id, list_dot_product(q.v, e.embedding::DOUBLE[]) / q.n AS s FROM q, embeddings e),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS k FROM p WHERE s >= 0.25)
    SELECT query_id, item_id, round(s, 4) AS similarity FROM r WHERE k <= 5
""")
def vector_topk(spark, d):
    """V1: the five nearest of every vector whose id is divisible by 50, among all."""
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    index = e.select(F.col("vec_id").alias("item_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    return retrieval.top_k(queries, index, 5, 0.25).withColumn("similarity", F.round("similarity", 4))


@query("""
    WITH q AS (SELECT vec_id AS query_id, label, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS n FROM embeddings WHERE vec_id % 50 = 0),
    p AS (SELECT q.query_id, e.vec_id AS item_id, list_dot_product(q.v, e.embedding::DOUBLE[]) / q.n AS s FROM q JOIN embeddings e ON e.label = q.label),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS k FROM p WHERE s >= 0.1)
    SELECT query_id, item_id, round(least(1.0, s), 4) AS confidence FROM r WHERE k = 1
""")
def vector_accept(spark, d):
    """V1 with candidates, V2, V3, F32: the best hit of a query among its own label."""
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.array("label").alias("candidate_ids"))
    index = e.select(F.col("vec_id").alias("item_id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    hits = retrieval.reranked(retrieval.top_k(queries, index, 5, 0.1, candidates=True), None)
    return retrieval.accepted(hits, by_similarity=0.1).select("query_id", "item_id", F.round("confidence", 4).alias("confidence"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS length, 1.0::DOUBLE AS after FROM embeddings")
def vector_norms(spark, d):
    """F31."""
    from larder.functions.vectors import norm

    return table(spark, d, "embeddings").select("vec_id", F.round(norm(F.col("embedding")), 5).alias("length"), F.round(norm(normalised(F.col("embedding"))), 6).alias("after"))


@query("""
    SELECT doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY trim(text) ORDER BY n_chars DESC, doc_id) AS n FROM documents WHERE trim(text) <> '') WHERE n = 1
""")
def keep_max_dedupe(spark, d):
    """A22."""
    return assign.best_by_name(table(spark, d, "documents").withColumn("all", F.lit(1)), "all", "text", "n_chars", "doc_id").select("doc_id", "n_chars")


@query("""
    SELECT event_id, round(CASE WHEN max(value) OVER w - min(value) OVER w < 1e-9 THEN 1 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END, 6) AS scaled
    FROM events WINDOW w AS (PARTITION BY user_id)
""")
def minmax_norm(spark, d):
    """W3."""
    return windows.min_max(_events(spark, d), ["user_id"], "value", "scaled").select("event_id", F.round("scaled", 6).alias("scaled"))


@query("""
    WITH l AS (SELECT event_id, abs(value - lag(value) OVER w) AS a, abs(lead(value) OVER w - value) AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT event_id, round(CASE WHEN a IS NULL AND b IS NULL THEN 0 WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END, 6) AS diff FROM l
""")
def neighbour_diff(spark, d):
    """W2."""
    return windows.neighbour_difference(_events(spark, d), ["user_id"], ["ts", "event_id"], "value", "diff").select("event_id", F.round("diff", 6).alias("diff"))


@query("SELECT user_id, round(quantile_cont(value, 0.1), 6) AS p10, round(median(value), 6) AS p50 FROM events GROUP BY 1")
def percentiles(spark, d):
    """A20, A21."""
    e = _events(spark, d)
    low, mid = aggregates.baselines(e, ["user_id"], "value", "p10"), aggregates.baselines(e, ["user_id"], "value", "p50", 0.5)
    return low.join(mid, "user_id").select("user_id", F.round("p10", 6).alias("p10"), F.round("p50", 6).alias("p50"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) > 1 AS is_candidate FROM events")
def dup_second(spark, d):
    """W5, by hour."""
    return windows.duplicates_marked(_events(spark, d), [F.col("user_id"), F.date_trunc("hour", "ts")], ["ts", "event_id"]).select("event_id", "is_candidate")


@query("""
    WITH a AS (SELECT *, event_type = 'view' AS s FROM events), b AS (SELECT *, CASE WHEN lag(s) OVER w IS DISTINCT FROM s THEN 1 ELSE 0 END AS c FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    e AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM b)
    SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS streak FROM e
""")
def sessions_streak(spark, d):
    """W6."""
    out = windows.streaks(_events(spark, d), ["user_id"], ["ts", "event_id"], F.col("event_type") == "view")
    return out.select("event_id", F.col("streak").cast("long").alias("streak"))


@query("""
    SELECT event_id, arg_max(event_id, (value, event_id)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak_event,
           arg_max(event_id, (value, -epoch_us(ts))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 7 PRECEDING) AS best_of_last FROM events
""")
def running_peaks(spark, d):
    """W7, W9."""
    e = _events(spark, d).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    out = windows.running_peak(e, ["user_id"], ["ts", "event_id"], "value", "event_id", "peak_event")
    return windows.best_of_last(out, ["user_id"], ["at", "event_id"], 8, "event_id", "value", "best_of_last").select("event_id", "peak_event", "best_of_last")


@query("""
    SELECT o_custkey, strftime(max(o_orderdate), '%Y-%m-%d') AS day, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1
""")
def latest_rows(spark, d):
    """L3, L4, W10."""
    out = paging.latest(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey")
    return out.select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey")


_BOX = "p_size + 1.0 AS x1, p_partkey % 60 + 0.0 AS y1, p_size + 20.0 + p_partkey % 30 AS x2, p_partkey % 60 + 25.0 AS y2"


@query(f"""
    WITH b AS (SELECT p_partkey, {_BOX} FROM part), a AS (SELECT *, greatest(0, least(x2, 60.0) - greatest(x1, 10.0)) * greatest(0, least(y2, 60.0) - greatest(y1, 10.0)) AS cut FROM b)
    SELECT p_partkey, round(cut / ((x2 - x1) * (y2 - y1) + 2500 - cut), 6) AS iou,
           ['左上','上方','右上','左侧','中间','右侧','左下','下方','右下'][1 + 3 * (CASE WHEN (y1 + y2) / 2 / 90 < 1.0/3 THEN 0 WHEN (y1 + y2) / 2 / 90 > 2.0/3 THEN 2 ELSE 1 END)
             + (CASE WHEN (x1 + x2) / 2 / 100 < 1.0/3 THEN 0 WHEN (x1 + x2) / 2 / 100 > 2.0/3 THEN 2 ELSE 1 END)] AS position,
           x2 - x1 >= 24 AND y2 - y1 >= 24 AS large FROM a
""")
def bbox_iou(spark, d):
    """F10-F13, P22, on boxes made of parts in an image of 100 by 90."""
    p = table(spark, d, "part").select("p_partkey", geometry.box(F.col("p_size") + 20.0 + F.col("p_partkey") % 30, F.col("p_partkey") % 60 + 25.0, F.col("p_size") + 1.0, F.col("p_partkey") % 60 + 0.0).alias("b"))
    fixed = geometry.box(*(F.lit(x) for x in (10.0, 10.0, 60.0, 60.0)))
    return p.select(
        "p_partkey", F.round(geometry.iou(F.col("b"), fixed), 6).alias("iou"),
        geometry.position(F.col("b"), F.lit(100), F.lit(90), "pixels").alias("position"), geometry.large_enough(F.col("b")).alias("large"),
    )


@query("""
    SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS squeezed, CASE WHEN coalesce(text, '') = '' THEN '**' ELSE left(text, 1) || '*' END AS masked
    FROM conversations
""")
def text_notes(spark, d):
    """F1, F26."""
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", text.squeezed(F.col("text")).alias("squeezed"), text.masked(F.col("text")).alias("masked"))


@query()
def fuzzy_name(spark, d):
    """Part names with a mark against all distinct ones; held against plain Python by tests."""
    parts = table(spark, d, "part")
    names = parts.where("p_name is not null").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("pos"))
    return joins.fuzzy_names(parts.select("p_partkey", F.concat(F.col("p_name"), F.lit(" x")).alias("raw_name")), names)


@query()
def nms(spark, d):
    """Boxes of line items, an image being an order; held against plain Python by tests."""
    l = table(spark, d, "lineitem")
    b = l.select(
        F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").cast("long").alias("det_id"), (F.col("l_partkey") % 7).cast("string").alias("name"), F.round(F.col("l_discount") + F.col("l_tax"), 4).alias("confidence"),
        (F.col("l_quantity") % 10).alias("x1"), (F.col("l_suppkey") % 10 + 0.0).alias("y1"), (F.col("l_quantity") % 10 + 12).alias("x2"), (F.col("l_suppkey") % 10 + 12.0).alias("y2"),
    )
    return assign.suppressed(b)


@query()
def tray_events(spark, d):
    """users' events as frames of a channel; the streamed form is held against this by tests."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    f = _events(spark, d).select(
        F.col("user_id").alias("channel_id"), F.row_number().over(w).alias("frame_no"), (F.col("value") / 100).alias("motion_score"), (F.col("event_type") == "click").alias("moving"),
        (F.col("event_type") != "error").alias("present"), *((F.col("value") * (i + 1) % 17).alias(c) for i, c in enumerate(("laplacian", "tenengrad", "local_clarity"))),
        *(F.lit(0.0).alias(c) for c in ("high_freq_ratio", "exposure_outlier_ratio", "temporal_diff", "edge_touch_ratio", "center_distance_ratio")), (F.col("value") % 1).alias("completeness"),
    )
    return event_machines.events(f, settings=event_machines.M.Settings(enter=2, leave=2, sample_every=1))


@query("""
    WITH e AS (SELECT event_id, user_id, ts, epoch_us(ts) AS at FROM events WHERE event_type = 'click'), s AS (SELECT event_id AS idx, user_id, epoch_us(ts) AS a, epoch_us(ts) + 3600000000 AS b FROM events WHERE event_type = 'login')
    SELECT e.event_id, min(s.idx) AS idx FROM e LEFT JOIN s ON e.user_id = s.user_id AND e.at BETWEEN s.a AND s.b GROUP BY 1
""")
def point_in_window(spark, d):
    """Clicks within an hour of a login."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    clicks = _events(spark, d, "click").select("event_id", "user_id", at.alias("at"))
    spans = _events(spark, d, "login").select(F.col("event_id").alias("idx"), "user_id", at.alias("a"), (at + 3_600_000_000).alias("b"))
    return joins.within_interval(clicks, spans, "at", "a", "b", "idx", 3_600_000_000, ["user_id"]).select("event_id", "idx")


from larder.plans import more_queries, wide_queries  # noqa: E402, F401  they add to QUERIES and SQL
