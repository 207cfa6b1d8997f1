"""Upserts as pure merges: (old, new) -> next (K2-K8). Writing the result over the old table is the sink's part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key (K2, K3, K7)."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*old.columns))


def replaced_children(old: DataFrame, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children after their parents were looked at again: those of `parents` go, new ones come (K7)."""
    return old.join(parents.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def merged_menus(old: DataFrame, new: DataFrame, today, back: int = 7, ahead: int = 30) -> DataFrame:
    """Menus (menu_date, dish_ids, is_default) after an upsert by date: dates over `back` days ago or more
    than `ahead` days from `today` aren't taken; a menu without dishes is a default (K3)."""
    day = F.lit(today).cast("date")
    taken = new.where(F.col("menu_date").between(F.date_sub(day, back), F.date_add(day, ahead)))
    taken = taken.select("menu_date", F.coalesce("dish_ids", F.array()).alias("dish_ids"))
    return upsert(old, taken.withColumn("is_default", F.size("dish_ids") == 0), ["menu_date"])


def merged_users(old: DataFrame, new: DataFrame) -> DataFrame:
    """Users after a sync, by external id: names and departments are overwritten, a known user keeps the
    role, and all that came are active again (K6)."""
    fresh = new.withColumn("is_active", F.lit(True))
    return coalesced(old, fresh, F.col("external_id"), F.col("external_id"), ["name", "department", "is_active"], [], ["external_id", "role"])


def last_of(new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key, as where later rows of a file overwrite earlier ones (K4)."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def coalesced(old: DataFrame, new: DataFrame, key: Column, old_key: Column, always: list[str], if_given: list[str], keep: list[str]) -> DataFrame:
    """A merge in which `always` columns take the new value, `if_given` ones only a new value that isn't
    null or blank, `keep` ones stay; unknown keys are added (K5, K6). Keys may be expressions."""
    o, n = old.withColumn("_key", old_key), new.withColumns({"_key": key, "_row": F.lit(1)})
    both = o.alias("o").join(n.alias("n"), "_key", "full_outer")
    came = F.col("n._row").isNotNull()

    def value(c: str) -> Column:
        fresh, stale = F.col(f"n.{c}"), F.col(f"o.{c}")
        if c in always:
            return F.when(came, fresh).otherwise(stale)
        if c in if_given:
            given = F.nullif(F.trim(fresh), F.lit("")) if dict(new.dtypes)[c] == "string" else fresh
            return F.coalesce(given, stale)
        return F.coalesce(stale, fresh)

    return both.select(*(value(c).alias(c) for c in [*keep, *always, *if_given]))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def soft_delete(df: DataFrame, gone: Column) -> DataFrame:
    """K8."""
    return df.withColumn("is_active", F.col("is_active") & ~F.coalesce(gone, F.lit(False)))
