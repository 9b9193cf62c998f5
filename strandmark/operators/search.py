"""Directory search: words, facets, visible sections, candidates, order and limits."""

from __future__ import annotations

from itertools import accumulate

import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmark.functions.text import blank, normalize
from strandmark.operators.trigrams import containing

def all_words(text: Column, query: str) -> Column:
    """Every word of the query is a substring of the text, both normalised; a blank query matches all, a null text is empty.

    The words are known when the plan is made, so this is a conjunction of ``contains`` that needs no array.
    """
    read, found = normalize(blank(text)), F.lit(True)  # one expression, which the plan computes once a row
    for word in regex.split(r"[\s\p{Z}]+", query or ""):
        if word:
            found &= F.contains(read, normalize(F.lit(word)))
    return found


def all_words_of(text: Column, query: Column) -> Column:
    """The same for a query in a column."""
    words = F.filter(F.split(normalize(blank(query)), r"[\s\p{Z}]+"), lambda w: w != "")
    return F.forall(words, lambda w: F.contains(normalize(blank(text)), w))


def any_location(location: Column, active: list[str]) -> Column:
    """Some active location is a substring; none active matches all."""
    found = F.lit(not active)
    for name in active:
        found |= F.coalesce(F.contains(location, F.lit(name)), F.lit(False))
    return found


def any_category(category: Column, active: list[str]) -> Column:
    return F.coalesce(category.isin(active), F.lit(False)) if active else F.lit(True)


def search(cards: DataFrame, query: str = "", locations: list[str] | None = None, categories: list[str] | None = None, *, text: str, location: str, category: str) -> DataFrame:
    """Cards that match the words, a location and a category."""
    return cards.filter(all_words(F.col(text), query) & any_location(F.col(location), locations or []) & any_category(F.col(category), categories or []))


def visible_sections(sections: DataFrame, cards: DataFrame, key: str) -> DataFrame:
    """Sections with a visible card. Keys are made distinct first, so the semi-join moves one row a section."""
    return sections.join(cards.select(key).distinct(), key, "left_semi")


def near_locations(orgs: DataFrame, locations: DataFrame, location: str = "loc", name: str = "name") -> DataFrame:
    """Rows of ``orgs`` whose location contains a name of ``locations``; without names, none."""
    return containing(orgs, locations, location, name)


def candidates(favourites: DataFrame, nearby: DataFrame, key: str, position: str, user: str | None = None, most: int = 10) -> DataFrame:
    """Favourites, then nearby ones that aren't among them, in their own order, at most ``most`` (for each user)."""
    both = favourites.withColumn("src_rank", F.lit(0)).unionByName(nearby.withColumn("src_rank", F.lit(1)))
    keys = [*([user] if user else []), key]
    columns = [c for c in both.columns if c not in {*keys, "src_rank", position}]
    once = both.groupBy(*keys).agg(F.min(F.struct("src_rank", position, *columns)).alias("_r")).select(*keys, "_r.src_rank", f"_r.{position}", *(F.col(f"_r.{c}").alias(c) for c in columns))
    if user is None:
        return once.orderBy("src_rank", position, key).limit(most)
    rank = F.row_number().over(Window.partitionBy(user).orderBy("src_rank", position, key))
    return once.withColumn("_n", rank).filter(F.col("_n") <= most).drop("_n")


def newest_first(df: DataFrame, time: str, tie: str) -> DataFrame:
    return df.orderBy(F.desc(time), F.desc(tie))


def german(column: str) -> Column:
    """A text as the German collation orders it: Aarau, Ägeri, Basel."""
    return F.collate(column, "de")


def german_order(df: DataFrame, column: str) -> DataFrame:
    return df.orderBy(german(column))


def ranked(df: DataFrame, order: list[Column | str], path: str, name: str = "place") -> DataFrame:
    """Adds ``name``: the place of each row, from 1, in the order of the whole table, in which ``order`` should leave no ties.

    Rows are ranged and sorted in parts and written to ``path`` with their number within the part; the parts' counts, one a part, give the
    number that each part begins with. So no task sees more than its part, and rows are shuffled once.
    """
    keys = {f"_k{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}
    numbered = df.withColumns(keys).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys).withColumn("_id", F.monotonically_increasing_id())
    numbered.write.parquet(path)
    # the number holds the part above 33 bits, and the position in it below
    rows, part = df.sparkSession.read.parquet(path), F.shiftright("_id", 33)
    counts = dict(sorted((r["p"], r["count"]) for r in rows.groupBy(part.alias("p")).count().collect()))
    begins = [x for p, begin in zip(counts, accumulate(counts.values(), initial=0)) for x in (F.lit(p), F.lit(begin))]
    begin = F.element_at(F.create_map(*begins), part) if begins else F.lit(0)
    return rows.withColumn(name, begin + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_id")


def top_scores(df: DataFrame, score: str, name: str, tie: str, most: int = 10) -> DataFrame:
    return df.orderBy(F.desc(score), name, tie).limit(most)
