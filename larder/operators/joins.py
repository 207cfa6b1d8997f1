"""Joins (J1-J24). Band joins meet on time buckets, so that Spark hashes instead of looping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.functions.python import text_ratio
from larder.functions.text import name_key
from larder.operators.nearest import nearest_in_band
from larder.sources.scratch import Scratch, small


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def band_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, seconds: float, by: list[str] | None = None) -> DataFrame:
    """All pairs of at most `seconds` between their times, both ends included. Columns must differ, but
    for `by`, on which pairs must agree as well.

    Each right row stands in its bucket and both neighbours, each left row in its own; buckets are as
    wide as the band, so a pair meets once. The right side should be the smaller: it grows threefold.
    """
    width = max(int(seconds * 1_000_000), 1_000_000)
    key = F.floor(_micros(left_time) / width)
    near = F.explode(F.sequence(F.floor(_micros(right_time) / width) - 1, F.floor(_micros(right_time) / width) + 1))
    pairs = left.withColumn("_bucket", key).join(right.withColumn("_bucket", near), ["_bucket", *(by or [])])
    return pairs.where(F.abs(_micros(left_time) - _micros(right_time)) <= int(seconds * 1_000_000)).drop("_bucket")


def nearest_match(
    records: DataFrame,
    images: DataFrame,
    seconds: float = 1.0,
    price_tolerance: float = 0.5,
    record_id: str = "record_id",
    image_id: str = "image_id",
    record_time: str = "record_time",
    image_time: str = "image_time",
    amount: str = "amount",
    total: str = "total",
    by: list[str] | None = None,
) -> DataFrame:
    """For each record the image in its band whose total is nearest: (record_id, image_id, status,
    time_diff, price_diff), a row per record (J1, J3).

    status: matched within `price_tolerance`, time_matched_only beyond, unmatched_record without an image.
    Ties: the nearer time, then the smaller image id. A null total is 0. The image is looked up in an index
    of its bucket of time, so that a record writes a few rows however many images its band has.
    """
    r = records.select(F.col(record_id).alias("record_id"), _micros(record_time).alias("at"), F.col(amount).cast("double").alias("value"), *(by or []))
    i = images.select(F.col(image_id).cast("long").alias("id"), _micros(image_time).alias("at"), F.col(total).cast("double").alias("value"), *(by or []), *(F.lit(None).cast("long").alias(c) for c in ("until_at", "until_id")))
    best = nearest_in_band(r.withColumn("id", F.col("record_id").cast("long")), i, seconds, by)
    return r.select("record_id").join(best, F.col("record_id") == F.col("record"), "left").select(
        "record_id",
        F.col("image").alias("image_id"),
        F.when(F.col("image").isNull(), "unmatched_record").when(F.col("price_diff") <= price_tolerance, "matched").otherwise("time_matched_only").alias("status"),
        (F.col("time_diff") / 1_000_000).alias("time_diff"),
        "price_diff",
    )


def unmatched(images: DataFrame, matches: DataFrame, key: str = "image_id") -> DataFrame:
    """Images that no match names. Matches without an image don't count."""
    return images.join(matches.where(F.col(key).isNotNull()).select(key), key, "left_anti")


def without_near(images: DataFrame, records: DataFrame, image_time: str, record_time: str, seconds: float, key: str = "image_id") -> DataFrame:
    """Images whose id has no record within `seconds` of it, both ends included.

    No pairs are made. In a bucket of time as wide as the band all are near; of the bucket before only the last
    record can be near, of the one after only the first. So records become their first and last of a bucket.
    """
    width = max(int(seconds * 1_000_000), 1)
    at = F.floor(_micros(record_time) / width)
    ends = records.where(F.col(record_time).isNotNull()).groupBy(at.alias("_bucket")).agg(F.min(_micros(record_time)).alias("_first"), F.max(_micros(record_time)).alias("_last"))
    seen = ends.select(F.explode(F.sequence(F.col("_bucket") - 1, F.col("_bucket") + 1)).alias("_near"), "*")
    # what an image of bucket _near may see: the last record before it, the first after it, or one of its own bucket
    own = F.col("_near") == F.col("_bucket")
    seen = seen.groupBy("_near").agg(
        F.max(own).alias("_own"), F.max(F.when(F.col("_bucket") < F.col("_near"), F.col("_last"))).alias("_before"), F.min(F.when(F.col("_bucket") > F.col("_near"), F.col("_first"))).alias("_after")
    )
    t, band = _micros(image_time), int(seconds * 1_000_000)
    near = F.coalesce("_own", F.lit(False)) | F.coalesce(t - F.col("_before") <= band, F.lit(False)) | F.coalesce(F.col("_after") - t <= band, F.lit(False))
    found = images.withColumn("_near", F.floor(t / width)).join(seen, "_near", "left").withColumn("_found", near)
    return unmatched(images, found.where("_found"), key)


def match_listing(records: DataFrame, matches: DataFrame, key: str, match_order: list[Column]) -> DataFrame:
    """Records with their first match; those without get status unmatched_record."""
    first = matches.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*match_order))).where("_n = 1").drop("_n")
    return records.join(first, key, "left").withColumn("status", F.coalesce("status", F.lit("unmatched_record")))


def lookup_sum(facts: DataFrame, items: DataFrame, key: str, item: str, value: str, out: str, of: DataFrame | None = None) -> DataFrame:
    """Sum of the items' values per key; keys of `of` without any have 0 (J12, A7). Null values add 0."""
    sums = facts.join(items, item).groupBy(key).agg(F.coalesce(F.sum(value), F.lit(0)).alias(out))
    return sums if of is None else of.select(key).distinct().join(sums, key, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def in_given_order(items: DataFrame, ids: list, key: str) -> DataFrame:
    """Items of a list in the list's order, at the list's first mention; unknown ids drop out."""
    kind = items.schema[key].dataType.simpleString()
    wanted = items.sparkSession.createDataFrame([(i, n) for n, i in enumerate(dict.fromkeys(ids))], f"{key} {kind}, pos int")
    return items.join(F.broadcast(wanted), key).orderBy("pos")  # a literal list


def either_key(rows: DataFrame, people: DataFrame, column: str, first: str, second: str, id_column: str, out: str = "found_id") -> DataFrame:
    """The person whose `first` key equals the row's, else whose `second` does; of several the smallest
    id. Two hash joins, since an OR of keys would loop (J15)."""
    one, two = (people.where(F.col(k).isNotNull()).groupBy(F.col(k).alias(column)).agg(F.min(id_column).alias(f"_{k}")) for k in (first, second))
    found = rows.join(one, column, "left").join(two, column, "left")
    return found.withColumn(out, F.coalesce(f"_{first}", f"_{second}")).drop(f"_{first}", f"_{second}")


def by_name(rows: DataFrame, names: DataFrame, raw: str, name: str, id_column: str) -> DataFrame:
    """Ids by name, whatever the case; null where none fits; of several names the smallest id."""
    key = names.groupBy(F.lower(name).alias("_key")).agg(F.min(id_column).alias(id_column))
    return rows.join(key, F.lower(rows[raw]) == key["_key"], "left").drop("_key")


def members(users: DataFrame, array: str, key: str) -> DataFrame:
    """A row per element of a user's array, to join on."""
    return users.withColumn(key, F.explode(array))


def dyadic(first: str, last: str) -> Column:
    """Nodes (level, node) that cover the whole numbers from column `first` to column `last` without
    overlap: node n of level l covers n * 2^l and the 2^l - 1 numbers after it. At most two a level."""
    at = f"-shiftright(-{first}, l)", f"shiftright({last} + 1, l)"
    left = f"CASE WHEN {at[0]} < {at[1]} AND {at[0]} & 1 = 1 THEN struct(l AS level, {at[0]} AS node) END"
    right = f"CASE WHEN {at[0]} < {at[1]} AND {at[1]} & 1 = 1 THEN struct(l AS level, {at[1]} - 1 AS node) END"
    levels = f"sequence(0, CAST(floor(log2({last} - {first} + 2)) AS INT))"
    return F.expr(f"CASE WHEN {first} <= {last} THEN filter(flatten(transform({levels}, l -> array({left}, {right}))), x -> x IS NOT NULL) END")


def spans_indexed(spans: DataFrame, start: str, end: str, index: str, width: int, by: list[str]) -> DataFrame:
    """(by, level, node, _s, _e, index): where points look for the spans that hold them.

    The cells of `width` where a span begins and ends stand there with its ends. Those between, which it
    covers, stand as dyadic nodes, some two for each doubling of its length; of all spans that cover a node
    only the smallest index stays.
    """
    s = spans.where(F.col(start) <= F.col(end)).select(*by, F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(index).alias(index))
    s = s.withColumns({"_a": F.floor(F.col("_s") / width), "_b": F.floor(F.col("_e") / width)})
    ends = s.select(*by, F.lit(0).alias("level"), F.explode(F.array_distinct(F.array("_a", "_b"))).alias("node"), "_s", "_e", index)
    between = s.withColumns({"_c": F.col("_a") + 1, "_d": F.col("_b") - 1}).select(*by, F.explode(dyadic("_c", "_d")).alias("n"), index)
    whole = between.groupBy(*by, "n.level", "n.node").agg(F.min(index).alias(index)).select(*by, "level", "node", F.lit(None).alias("_s"), F.lit(None).alias("_e"), index)
    return ends.unionByName(whole)


def within_interval(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, index: str, width: int, by: list[str] | None = None) -> DataFrame:
    """Each point with the first span (smallest `index`) that holds it, ends included; null if none does
    (J20, K14). Points look in their own cell of `width` and, where spans are longer than that, in the node
    above it on each level that occurs; a span's rows grow with the logarithm of its length."""
    by = by or []
    nodes = Scratch(points.sparkSession).put(spans_indexed(spans, start, end, index, width, by), "spans")
    levels = sorted({0, *(r["level"] for r in nodes.select("level").distinct().collect())})  # 64 at most
    p = points.withColumn("_row", F.monotonically_increasing_id())
    level = F.explode(F.array(*map(F.lit, levels)))
    keyed = p.withColumn("level", level).withColumn("node", F.expr(f"shiftright(floor({at} / {width}), level)"))
    held = F.col("_s").isNull() | F.col(at).between(F.col("_s"), F.col("_e"))
    found = keyed.join(nodes, ["level", "node", *by], "left").groupBy(*points.columns, "_row").agg(F.min(F.when(held, F.col(index))).alias(index))
    return found.drop("_row")


def effective_list(keys: DataFrame, custom: DataFrame, key: str, slot: str, fallback_all: DataFrame | None = None) -> DataFrame:
    """The slot's own list, else all slots' lists in one; with `fallback_all` (ids) where that is empty
    too, every id (J22). custom: (key, slots map<string, array<int>>)."""
    slots = F.col("slots")
    everything = F.array_distinct(F.flatten(F.map_values(slots)))
    own = F.element_at(slots, slot) if isinstance(slot, str) and slot not in keys.columns else F.try_element_at(slots, F.col(slot))
    chosen = F.when(F.size(F.coalesce(own, F.array())) > 0, own).otherwise(F.coalesce(everything, F.array().cast("array<int>")))
    out = keys.join(custom, key, "left").withColumn("ids", chosen).drop("slots")
    if fallback_all is None:
        return out
    ids = fallback_all.agg(F.array_sort(F.collect_set("id")).alias("_all"))  # one row, as long as each row that it fills
    most = 1_000_000
    ids = F.broadcast(ids) if fallback_all.limit(most + 1).count() <= most else ids.hint("shuffle_replicate_nl")
    return out.join(ids, how="cross").withColumn("ids", F.when(F.size("ids") > 0, F.col("ids")).otherwise(F.col("_all"))).drop("_all")


def fuzzy_names(rows: DataFrame, names: DataFrame, raw: str = "raw_name", name: str = "name", order: str = "pos", least: float = 0.72) -> DataFrame:
    """rows with `name`: equal after normalising, else the best of those that contain it or are contained,
    else the most similar of at least `least`; null if there is none (J17).

    Equal names meet by hash. What is left meets only where a pair can count: names inside one another and
    names alike enough share two characters in a row, or are so short that single ones are looked at. A
    ratio is computed once per pair of distinct normalised names.
    """
    spelled = rows.select(raw).distinct().withColumn("_key", name_key(F.col(raw))).where("_key <> ''")
    keys = spelled.select("_key").distinct()
    c = names.select(F.col(name).alias("_name"), F.col(order).alias("_order"), name_key(F.col(name)).alias("_cand"))
    c = c.groupBy("_cand", "_order").agg(F.max("_name").alias("_name")).groupBy("_cand").agg(F.min(F.struct("_order", "_name")).alias("_first"), F.max("_name").alias("_last"))
    equal = keys.join(c, F.col("_key") == F.col("_cand")).select("_key", F.col("_first._name").alias(name))
    rest = keys.join(equal, "_key", "left_anti")

    inside = F.contains("_cand", "_key") | F.contains("_key", "_cand")
    both = F.length("_key") + F.length("_cand")
    near = inside | (2 * F.least(F.length("_key"), F.length("_cand")) >= least * both - 1e-9)
    left = rest.withColumn("_gram", F.explode(_grams("_key", least, "key", "cand")))
    right = c.select("_cand", F.explode(_grams("_cand", least, "cand", "key")).alias("_gram"))
    pairs = left.join(right, "_gram").where(near).select("_key", "_cand").distinct()
    empty = c.where("_cand = ''").select("_cand")  # one row at most; it is inside every name
    pairs = pairs.unionAll(rest.crossJoin(F.broadcast(empty)))
    pairs = pairs.withColumn("_ratio", text_ratio("_key", "_cand")).withColumn("_inside", inside)
    pairs = pairs.where(F.col("_inside") | (F.col("_ratio") >= least)).join(c, "_cand")
    # of equal containments the larger name, of all others the first
    rank = F.struct(
        F.when(F.col("_inside"), 1).otherwise(2).alias("tier"),
        (-F.col("_ratio")).alias("ratio"),
        F.when(F.col("_inside"), F.length("_cand")).otherwise(0).alias("length"),
        F.when(~F.col("_inside"), F.col("_first._order")).alias("order"),
    )
    ranked = pairs.select("_key", rank.alias("_rank"), F.when(F.col("_inside"), F.col("_last")).otherwise(F.col("_first._name")).alias("_name"))
    ranked = ranked.groupBy("_key", "_rank").agg(F.max("_name").alias("_name"))
    alike = ranked.groupBy("_key").agg(F.min(F.struct("_rank", "_name")).alias("_best")).select("_key", F.col("_best._name").alias(name))
    found = spelled.join(equal.unionAll(alike), "_key").select(raw, name)
    return rows.join(found, raw, "left")


def _grams(text: str, least: float, own: str, other: str) -> Column:
    """What `text` shares with every text that contains it, is contained in it or has a ratio of at least
    `least` with it.

    Texts of S characters together and that ratio have least * S / 2 characters in matching blocks, with
    (1 - least) * S gaps between blocks at most: where all blocks can be single characters, S is at most
    1 / (1.5 * least - 1), or without bound below a ratio of two thirds. Those texts have their characters
    too. A text of one character looks for it in all others.
    """
    singles = F.array_distinct(F.split(text, ""))
    n = F.length(text)
    none = F.array().cast("array<string>")
    short = n < 1 / (1.5 * least - 1) if 1.5 * least > 1 else F.lit(True)
    return F.array_distinct(
        F.concat(
            F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, F.lit(2)))).otherwise(none),
            F.when(short, singles).otherwise(none),
            F.when(n == 1, F.array(F.concat(F.lit(f"{own} "), text))).otherwise(none),
            F.transform(singles, lambda x: F.concat(F.lit(f"{other} "), x)),
            F.array(F.lit("any")) if least <= 0 else none,
        )
    )


def contained_names(rows: DataFrame, names: DataFrame, raw: str, name: str, order: str) -> DataFrame:
    """The name equal to the raw one, else the first that contains it or is contained; each name once, at
    its first row by `raw` (J18)."""
    a, b = F.lower(F.trim(raw)), F.lower(F.trim(name))
    left = rows.select(raw).distinct().withColumn("_key", a).where("_key is not null")
    right = names.select(name, order).withColumn("_cand", b).where("_cand is not null")
    equal = left.join(right, F.col("_key") == F.col("_cand")).groupBy(raw).agg(F.min_by(name, order).alias(name))
    rest = left.join(equal, raw, "left_anti")
    # a name inside another shares two characters in a row with it, or is a character of it, or is empty
    gram = lambda x, own, other: F.explode(_grams(x, 2.0, own, other))
    pairs = rest.withColumn("_gram", gram("_key", "key", "cand")).join(right.withColumn("_gram", gram("_cand", "cand", "key")), "_gram")
    first = F.min(F.struct(F.col(order).alias("o"), F.col(name).alias("n"))).alias("m")
    found = pairs.where(F.contains("_cand", "_key") | F.contains("_key", "_cand")).groupBy(raw).agg(first)
    blank = right.where("_cand = ''").agg(first).where("m is not null")  # one row, inside every name
    every = right.agg(first).where("m is not null")  # one row: a blank raw name is inside every name
    found = found.unionByName(rest.select(raw).crossJoin(F.broadcast(blank))).unionByName(rest.where("_key = ''").select(raw).crossJoin(F.broadcast(every)))
    inside = found.groupBy(raw).agg(F.min("m").alias("m")).select(raw, F.col("m.n").alias(name))
    return equal.unionByName(inside).groupBy(name).agg(F.min(raw).alias(raw))
