"""Imports: payments, people, dishes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.numbers import amount
from larder.functions.text import squeezed, stripped
from larder.functions.times import parsed_time
from larder.operators.aggregates import outcome
from larder.operators.filters import first_error
from larder.operators.joins import either_key
from larder.operators.merge import blank_to_null, coalesced, last_of
from larder.sources.files import WEAK_ID_HEADERS, suggested_mapping


def mapped_payments(raw: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """(row, student_no, student_name, transaction_time, amount, raw_id, transaction_id, location, weak,
    error) of an export: error is null, missing or unparsed."""
    mapping = mapping or suggested_mapping(raw.columns)
    text = lambda f: stripped(F.col(f"`{mapping[f]}`")) if f in mapping else F.lit(None).cast("string")
    weak = mapping.get("transaction_id") in WEAK_ID_HEADERS
    fields = {f: text(f) for f in ("student_id", "student_name", "transaction_time", "amount", "transaction_id", "transaction_location")}
    out = raw.select(F.monotonically_increasing_id().alias("row"), *(v.alias(f) for f, v in fields.items()))
    there = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    whole = there("student_id") & there("transaction_time") & there("amount") & there("transaction_id")
    time, money = parsed_time(F.col("transaction_time")), amount(F.col("amount"))
    key = F.concat(F.lit("wallet:"), "student_id", F.lit(":"), "transaction_id") if weak else F.col("transaction_id")
    return out.select(
        "row", F.col("student_id").alias("student_no"), "student_name", time.alias("transaction_time"), money.alias("amount"),
        F.col("transaction_id").alias("raw_id"), key.alias("transaction_id"), squeezed(F.col("transaction_location")).alias("location"),
        F.lit(weak).alias("weak"), F.when(~whole, "missing").when(time.isNull() | money.isNull(), "unparsed").alias("error"),
    )


def _known(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """row of those payments that are there already: under their own id, and for wallet ids under the bare
    id, or under a longer wallet id with the same ends, of the same student or of none (F7).

    The three forms are three keys of one hash join: a wallet id with something between its ends is
    known by its first and last part.
    """
    ends = lambda c: F.concat(F.array_join(F.slice(F.split(c, ":"), 1, 2), ":"), F.lit(":*:"), F.element_at(F.split(c, ":"), -1))
    wallet = F.col("transaction_id").startswith("wallet:")
    long = wallet & (F.size(F.split("transaction_id", ":")) > 3)
    keys = existing.select(
        F.col("student_no").alias("known_no"),
        F.explode(F.filter(F.array(F.col("transaction_id"), F.when(long, ends("transaction_id"))), lambda x: x.isNotNull())).alias("key"),
    )
    own = F.when(F.col("weak"), F.array("transaction_id", "raw_id", ends("transaction_id"))).otherwise(F.array("transaction_id"))
    probes = rows.select("row", "student_no", "weak", F.explode(own).alias("key"))
    same = ~F.col("weak") | F.col("known_no").isNull() | (F.col("known_no") == F.col("student_no"))
    return probes.join(keys, "key").where(same).select("row").distinct()


def imported_payments(raw: DataFrame, existing: DataFrame, students: DataFrame, batch: str, mapping: dict[str, str] | None = None, allowed: list[str] | None = None) -> DataFrame:
    """Rows of an export with their outcome: imported, duplicate, by_location, missing or unparsed, and
    for imported ones the student found (A16).

    The location is looked at before duplicates are. Of one id in the file the first row counts.
    """
    columns = mapping or suggested_mapping(raw.columns)
    if allowed and "transaction_location" not in columns:
        raise ValueError("a list of locations needs a mapped location column")
    rows = mapped_payments(raw, mapping)
    outside = ~F.col("location").isin([" ".join(x.split()) for x in allowed]) if allowed else F.lit(False)
    rows = rows.withColumn("outside", outside)
    good = F.col("error").isNull() & ~F.col("outside")
    # an aggregate over good rows: those without an id are no group of their own
    first = rows.where(good).groupBy("transaction_id").agg(F.min("row").alias("first"))
    rows = rows.join(first, "transaction_id", "left").withColumn("again", good & (F.col("row") > F.col("first"))).drop("first")
    known = _known(rows.where(good), existing).withColumn("known", F.lit(True))
    rows = rows.join(known, "row", "left")
    result = outcome(
        (F.col("error").isNotNull(), "error"), (F.col("outside"), "by_location"), (F.col("again") | F.coalesce("known", F.lit(False)), "duplicate"), otherwise="imported"
    )
    rows = rows.withColumn("outcome", F.when(result == "error", F.col("error")).otherwise(result)).withColumn("import_batch", F.lit(batch))
    people = students.select("id", F.col("student_no").alias("by_no"), F.col("card_no").alias("by_card"))
    found = either_key(rows, people, "student_no", "by_no", "by_card", "id", "student_id")
    return found.drop("outside", "again", "known", "weak", "error")


def outcomes(imported: DataFrame) -> DataFrame:
    """(outcome, rows)."""
    return imported.groupBy("outcome").agg(F.count("*").alias("rows"))


def new_records(imported: DataFrame) -> DataFrame:
    return imported.where("outcome = 'imported'").select("student_id", "student_no", "student_name", "transaction_time", "amount", "transaction_id", "import_batch")


def merged_students(old: DataFrame, new: DataFrame, order: str = "row") -> DataFrame:
    """People after a roster: rows without number, name or class are left out, the last row of a number
    wins, blanks become null, known people keep their id (K4). new: roster columns and `row`."""
    names = ["student_no", "name", "class_id", "class_name", "grade_id", "grade_name", "card_no"]
    clean = new.select(*(blank_to_null(F.col(c)).alias(c) for c in names), order).where("student_no is not null and name is not null and class_id is not null")
    clean = last_of(clean, ["student_no"], [F.col(order)]).drop(order)
    both = old.select("id", "student_no", *(F.col(c).alias(f"old_{c}") for c in names[1:])).join(clean.withColumn("came", F.lit(True)), "student_no", "full_outer")
    return both.select("id", "student_no", *(F.when(F.col("came"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c) for c in names[1:]))


def merged_dishes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Dishes after a workbook, by name whatever the case: price, category and weight are overwritten,
    texts and nutrients only by values given, and dishes become active again (K5)."""
    nutrients = [c for c in ("calories", "protein", "fat", "carbohydrate", "sodium", "fiber") if c in new.columns]
    return coalesced(old, new.withColumn("is_active", F.lit(True)), F.lower("name"), F.lower("name"), ["price", "category", "weight", "is_active"], ["description", "ingredients", *nutrients], ["name"])


def dish_error(categories: list[str]) -> Column:
    """What is wrong with a dish's row, the first of it."""
    price = F.col("price").try_cast("double")
    return first_error(
        (F.coalesce(stripped(F.col("name")), F.lit("")) != "", "name"), (price.isNotNull(), "price"), (price >= 0, "negative price"), (F.col("category").isin(categories), "category")
    )
