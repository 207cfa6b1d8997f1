"""Line dedup by distinct-site spread.

A line that stands on many sites is boilerplate. How many sites a line has is counted by HyperLogLog
sketches, one per line hash, merged by aggregation; lines whose estimate is near the threshold get an
exact distinct count. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.llm.common import fresh, row_key, written


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def boilerplate(lines: DataFrame, min_sites: int = 5, lg_k: int = 10, band: float = 0.25) -> DataFrame:
    """Lines (line_a, line_b) that stand on at least `min_sites` sites, with the first place of each and
    their number of sites, as a stored table.

    lines: (line_a, line_b, site, place). A sketch of 2**lg_k registers has a relative standard error of
    1.04 / 2**(lg_k / 2), 3.3 % here. Estimates within `band` of the threshold (over seven such errors,
    and one site at least) are counted exactly, so that what is returned is exact.
    """
    line = ["line_a", "line_b"]
    spread = (
        lines.groupBy(*line)
        .agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.min("place").alias("first"))
        .select(*line, "first", F.hll_sketch_estimate("sketch").alias("sites"))
    )
    slack = max(1.0, band * min_sites)
    spread = written(spread.where(F.col("sites") >= min_sites - slack), "spread")
    near = spread.where(F.abs(F.col("sites") - min_sites) <= slack).select(*line)
    exact = (
        lines.select(*line, "site")
        .distinct()  # before the join: a line that a third of all rows hold is then a few rows a task
        .join(near, line, "left_semi")
        .groupBy(*line)
        .agg(F.count("*").alias("exact"))
    )
    common = spread.join(exact, line, "left").select(*line, "first", F.coalesce("exact", "sites").alias("sites"))
    # stored, so that the join of all lines with it can broadcast it if it is small, and split a hot line if not
    return written(common.where(F.col("sites") >= min_sites), "common")


def removals(docs: DataFrame, min_sites: int = 5, white: str = " ") -> DataFrame:
    """(key_a, key_b, gone array<int>) of the texts of `docs` (doc_id, text, site, key_a, key_b) that lose
    lines; gone has the numbers of these lines in order. The key tells rows apart by id and text. Lines are
    compared without characters of `white` at their ends, by 128 bits of them."""
    bare = lambda x: F.trim(x, F.lit(white))
    line = lambda x: F.when(bare(x) != "", F.struct(*row_key(bare(x))))
    places = docs.where("text is not null").select(
        # the order of rows: by id, those without one last, then by key
        F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "key_a", "key_b").alias("row"),
        F.coalesce("site", F.lit("\0none")).alias("site"),
        F.posexplode(F.transform(_lines("text"), line)).alias("pos", "line"),
    )
    places = places.where("line is not null").select(
        F.col("line.col1").alias("line_a"), F.col("line.col2").alias("line_b"), "site", F.struct("row.*", "pos").alias("place")
    )
    places = written(places, "lines")
    common = boilerplate(places, min_sites).select("line_a", "line_b", "first")
    return (
        places.join(common, ["line_a", "line_b"])
        .where(~F.col("place").eqNullSafe(F.col("first")))
        .groupBy("place.key_a", "place.key_b")
        .agg(F.array_sort(F.collect_set("place.pos")).alias("gone"))
    )


def without(text: str, gone: str) -> Column:
    """`text` without the lines whose numbers `gone` has, in order. One flag a line, up to the last that
    goes, so that filtering a text walks its lines once."""
    previous = lambda i: F.when(i == 0, F.lit(-1)).otherwise(F.get(gone, i - 1))
    stays = F.flatten(
        F.transform(gone, lambda p, i: F.concat(F.array_repeat(F.lit(True), p - previous(i) - 1), F.array(F.lit(False))))
    )
    # a lambda sees the flags as a field of its element, so that they are made once a text
    kept = F.transform(
        F.array(F.struct(_lines(text).alias("lines"), stays.alias("stays"))),
        lambda s: F.array_join(F.filter(s["lines"], lambda x, i: F.coalesce(F.get(s["stays"], i), F.lit(True))), "\n"),
    )
    return F.when(F.col(gone).isNull(), F.col(text)).otherwise(kept[0])


def cleaned(
    docs: DataFrame, min_sites: int = 5, white: str = " ", doc_id: str = "doc_id", text: str = "text", site: str = "source"
) -> tuple[DataFrame, str]:
    """`docs` with texts without the lines that at least `min_sites` sites share, and, in a further column
    whose name is returned, the numbers of the lines that went (null: none)."""
    a, b, gone = fresh(docs.columns, "key_a", "key_b", "gone")
    keyed = docs.withColumns(dict(zip((a, b), row_key(doc_id, text))))
    places = keyed.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).cast("string").alias("text"),
        F.col(site).cast("string").alias("site"),
        F.col(a).alias("key_a"),
        F.col(b).alias("key_b"),
    )
    lost = removals(places, min_sites, white).select(F.col("key_a").alias(a), F.col("key_b").alias(b), F.col("gone").alias(gone))
    return keyed.join(lost, [a, b], "left").withColumn(text, without(text, gone)).select(*docs.columns, gone), gone


def remove_boilerplate(
    docs: DataFrame, min_sites: int = 5, doc_id: str = "doc_id", text: str = "text", site: str = "source"
) -> DataFrame:
    """(doc_id, text, n_lines, n_removed), one row per row of `docs`: texts without the lines that at
    least `min_sites` sites share. Of each such line one stays: the first, by doc_id and place.

    Lines are compared without spaces at their ends; lines that are then empty always stay. A null site
    is a site of its own. A null text stays null and has no lines; a text of which nothing goes stays
    byte for byte. Rows that share a doc_id but not a text are rows of their own, ordered by a hash; rows
    alike in both lose the same lines. Rows with a null id come last in order. An empty table gives an
    empty table. Other columns of `docs`, whatever their names, aren't read.
    """
    docs = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(site).cast("string").alias("source")
    )
    found, gone = cleaned(docs.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines("text"))).cast("long")), min_sites)
    return found.select("doc_id", "text", "n_lines", F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"))
