"""Join-shaped operations; all are equi-joins by key whose hot keys AQE can split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def among(rows: DataFrame, chosen: DataFrame, key: str, chosen_key: str) -> DataFrame:
    """Rows whose key was chosen; unknown chosen keys have no effect."""
    return rows.join(chosen.select(F.col(chosen_key).alias(key)).distinct(), key, "left_semi")


def flagged(rows: DataFrame, chosen: DataFrame, key: str, chosen_key: str, flag: str = "is_fav") -> DataFrame:
    """All rows, with a flag for the chosen."""
    marks = chosen.select(F.col(chosen_key).alias(key), F.lit(True).alias(flag)).distinct()
    return rows.join(marks, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def missing(rows: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(present.select(*keys).distinct(), keys, "left_anti")


def valid_cache(rows: DataFrame, cache: DataFrame, key: str, expires: str, now: Column) -> DataFrame:
    """Rows with the cache row that hasn't expired, if any; a row that expires just now is valid."""
    return rows.join(cache.filter(F.col(expires) >= now), key, "left")


def looked_up(value: Column, table: dict[str, str]) -> Column:
    """The entry for a value, or the value itself."""
    pairs = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), value), value) if pairs else value


def slot_counts(counts: DataFrame, slots: DataFrame, key: str) -> DataFrame:
    """Counts for the places that have a slot to show them."""
    return counts.join(slots.select(key).distinct(), key)


def cascade(children: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    """Children that survive: those whose parent still exists."""
    return children.join(parents.select(F.col(key).alias(foreign)).distinct(), foreign, "left_semi")


def set_null(children: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    """All children; a reference to a parent that is gone becomes null."""
    kept = parents.select(F.col(key).alias(foreign), F.lit(True).alias("_there")).distinct()
    joined = children.join(kept, foreign, "left")
    return joined.withColumn(foreign, F.when(F.col("_there"), F.col(foreign))).drop("_there").select(children.columns)


def derived_profiles(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """The profile rows that new users get."""
    new = missing(users, profiles, ["id"]).select("id", "email")
    return new.withColumns({"workload_min": F.lit(50), "workload_max": F.lit(100), "desired_regions": F.array().cast("array<string>"), "exclusions": F.array().cast("array<string>")})
