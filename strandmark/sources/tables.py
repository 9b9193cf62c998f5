"""Reading: tables, nested literals, stored values, pages, files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmark.sources.files import read_files


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A table, or only some columns of it."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def spread(rows: DataFrame, tasks_per_core: int = 4) -> DataFrame:
    """The same rows dealt over all cores: small rows of few files, whose expressions take much longer than reading them."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism * tasks_per_core)


def flattened(categories: DataFrame, nested: str = "orgs") -> DataFrame:
    """One row for each organisation, with its category's key and the positions that keep the order."""
    one = categories.select(F.col("key").alias("category"), "category_pos", F.posexplode(nested).alias("org_pos", "_o"))
    return one.select("category", "category_pos", "org_pos", "_o.*")


def literal(spark: SparkSession, categories: list[dict], schema: str) -> DataFrame:
    """A nested literal as a table; ``category_pos`` is its order."""
    return spark.createDataFrame([{**c, "category_pos": i} for i, c in enumerate(categories)], f"{schema}, category_pos int")


def pdf_files(spark: SparkSession, path: str, most_bytes: int = 5 * 1024 * 1024) -> DataFrame:
    """PDF files of at most ``most_bytes``; the size is tested on the listing, before contents are read."""
    return read_files(spark, path, "*.pdf", most_bytes)


def single(df: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, none if there is none; more than one is an error."""
    found = df.filter(F.col(key) == F.lit(value))
    if found.limit(2).count() > 1:
        raise ValueError(f"{key} = {value!r} isn't unique")
    return found


#: Fixed value: the text of a page that couldn't be loaded.
NOT_LOADED = "(Karriereseite konnte nicht geladen werden)"


def live_pages(pages: DataFrame) -> DataFrame:
    """Text of fetched pages: null without an address or for a failed status, a placeholder after an exception."""
    from strandmark.functions.text import html_to_text

    text = F.when(F.coalesce("url", F.lit("")) == "", None).when(F.col("error").isNotNull(), F.lit(NOT_LOADED))
    return pages.withColumn("content", text.when(F.col("status").between(200, 299), html_to_text("html")))
