"""Counts and ordered text aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_where(df: DataFrame, condition: Column, name: str = "n") -> DataFrame:
    return df.filter(condition).agg(F.count("*").alias(name))


def count_by(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias(name))


def totals(orgs: DataFrame, category: str, favourites: DataFrame) -> DataFrame:
    """Organisations, categories and favourites; no favourites show as a dash."""
    both = orgs.select(F.lit(True).alias("own"), F.col(category).alias("c")).unionByName(favourites.select(F.lit(False).alias("own"), F.lit(None).alias("c")))
    n = F.count_if(~F.col("own"))
    shown = F.when(n == 0, "—").otherwise(n.cast("string"))
    return both.agg(F.count_if("own").alias("orgs"), F.countDistinct("c").alias("categories"), shown.alias("favourites"))


def kinds(df: DataFrame, keys: list[str], kind: str, values: list[str]) -> DataFrame:
    """How many rows of each kind, a column a kind."""
    return df.groupBy(*keys).agg(*(F.count_if(F.col(kind) == v).alias(f"n_{v}") for v in values))


def joined_text(value: Column, position: list[str], separator: str) -> Column:
    """Aggregate: non-null values in order of position, with a separator between them."""
    held = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(*position, value.alias("_v")))))
    return F.array_join(F.transform(held, lambda e: e["_v"]), separator)


def result_count(matches: Column) -> Column:
    """Number of matches, 0 for none or null."""
    return F.coalesce(F.when(matches.isNotNull(), F.size(matches)), F.lit(0))


def letter_count(letter: Column) -> Column:
    return F.when(F.length(letter) > 0, 1).otherwise(0)
