"""Writing: append, overwrite, text export, log rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmark.functions.text import blank, escape_html, line_breaks


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def log_rows(requests: DataFrame, user: str, payload: dict[str, Column], count: Column, now: Column) -> DataFrame:
    """Rows of the log table: parameters as JSON, number of results, time."""
    parameters = F.to_json(F.struct(*(v.alias(k) for k, v in payload.items())))
    return requests.select(F.col(user).alias("user_id"), parameters.alias("search_params"), count.cast("int").alias("results_count"), now.alias("created_at"))


def stored_values(df: DataFrame, key: str, value: Column) -> DataFrame:
    """Values of a key-value store as JSON text."""
    return df.select(F.col(key).alias("key"), F.to_json(value).alias("value"))


#: Fixed value: what stands before the organisation in a letter's title.
TITLE = "Bewerbung – "


def letters_as_html(df: DataFrame, text: str, language: Column, organization: Column) -> DataFrame:
    """Adds ``html``: the letter as a page that names its encoding, language and title. The text is markup already; null is empty."""
    head = F.concat(F.lit('<!DOCTYPE html>\n<html lang="'), escape_html(language), F.lit('">\n<head>\n<meta charset="utf-8">\n<title>' + TITLE), escape_html(organization), F.lit("</title>\n</head>\n<body>\n"))
    return df.withColumn("html", F.concat(head, line_breaks(blank(text)), F.lit("\n</body>\n</html>")))


def export_text(df: DataFrame, text: str, path: str) -> None:
    df.select(text).write.mode("overwrite").text(path)
