"""Context assembly: pages, profiles and documents as text with quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmark.functions.values import map_text, or_default
from strandmark.operators.counts import joined_text

NO_PROFILE = "Kein Profil angegeben."


def _lines(*parts: Column, separator: str = "\n") -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), separator)


def _if_text(c: Column, *shown: Column | str) -> Column:
    """The concatenation where ``c`` isn't empty, else null."""
    return F.when(F.coalesce(c, F.lit("")) != "", F.concat(*(F.lit(s) if isinstance(s, str) else s for s in shown)))


def page_content(cached: Column, live: Column, url: Column) -> Column:
    """The cached text, with or without an address; else the live one, null without an address."""
    return F.coalesce(cached, F.when(F.coalesce(url, F.lit("")) != "", live))


def page_blocks(pages: DataFrame, user: list[str], position: str, name: str, url: str, content: str) -> DataFrame:
    """Pages with content, numbered after the others are gone, as one text a user."""
    kept = pages.filter(F.col(content).isNotNull())
    number = F.row_number().over(Window.partitionBy(*user).orderBy(position))
    block = F.concat(F.lit("--- "), F.col("_i").cast("string"), F.lit(". "), F.col(name), F.lit(" ("), F.col(url), F.lit(") ---\n"), F.col(content))
    return kept.withColumn("_i", number).groupBy(*user).agg(joined_text(block, ["_i"], "\n\n").alias("pages_text"))


def profile_text(p: str | None = None) -> Column:
    """Labelled lines of what a profile has; columns as in the profile table, or fields of the struct ``p``."""
    c = lambda name: F.col(f"{p}.{name}" if p else name)
    listed = lambda name: _if_text(F.array_join(F.coalesce(c(name), F.array().cast("array<string>")), ", "), F.array_join(c(name), ", "))
    label = lambda text, value: F.concat(F.lit(f"{text}: "), value)
    low, high = c("workload_min"), c("workload_max")
    either = (F.coalesce(low, F.lit(0)) != 0) | (F.coalesce(high, F.lit(0)) != 0)
    workload = F.concat(or_default(low, 50).cast("string"), F.lit("% – "), or_default(high, 100).cast("string"), F.lit("%"))
    text = _lines(
        _if_text(c("education"), "Ausbildung: ", c("education")),
        _if_text(c("field_of_study"), "Fachrichtung: ", c("field_of_study")),
        _if_text(c("experience"), "Berufserfahrung: ", c("experience"), " Jahre"),
        label("Gewünschte Regionen", listed("desired_regions")),
        F.when(either, label("Pensum", workload)),
        F.when(F.size(F.map_keys(c("languages"))) > 0, label("Sprachen", map_text(c("languages")))),
        _if_text(c("keywords"), "Stichwörter: ", c("keywords")),
        label("Ausschlüsse", listed("exclusions")),
        _if_text(c("exclusions_freetext"), "Weitere Ausschlüsse: ", c("exclusions_freetext")),
        _if_text(c("start_date"), "Starttermin: ", c("start_date")),
    )
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(NO_PROFILE))


def _first(docs: Column, condition) -> Column:
    return F.get(F.filter(docs, condition), 0)


def _certificates(docs: Column, text: str, most: int = 3) -> Column:
    kept = F.filter(docs, lambda d: (d["doc_type"] == "zeugnis") & (F.coalesce(d[text], F.lit("")) != ""))
    return F.slice(kept, 1, most)


def documents_text(docs: Column, cv_chars: int = 4000, certificate_chars: int = 2000) -> Column:
    """The first CV and up to three certificates with text, each cut to its quota."""
    cv = _first(docs, lambda d: d["doc_type"] == "cv")
    certificates = _certificates(docs, "raw_text")
    period = lambda d: F.coalesce(_if_text(d["period"], " (", d["period"], ")"), F.lit(""))
    header = lambda d: F.coalesce(_if_text(d["employer"], "--- ", d["employer"], period(d), " ---"), F.lit("--- Arbeitszeugnis ---"))
    blocks = F.transform(certificates, lambda d: F.concat(header(d), F.lit("\n"), F.substring(d["raw_text"], 1, certificate_chars)))
    cv_part = F.when(F.coalesce(cv["raw_text"], F.lit("")) != "", F.array(F.concat(F.lit("\n\nLEBENSLAUF:\n"), F.substring(cv["raw_text"], 1, cv_chars)))).otherwise(F.array().cast("array<string>"))
    rest = F.when(F.size(blocks) > 0, F.concat(F.array(F.lit("\n\nARBEITSZEUGNISSE:")), blocks)).otherwise(F.array().cast("array<string>"))
    return F.coalesce(F.array_join(F.concat(cv_part, rest), "\n"), F.lit(""))


def certificates_text(certificates: Column, chars: int = 1500) -> Column:
    """Up to three certificates for a letter: employer, period, quotes, content."""
    quotes = lambda d: F.array_join(F.coalesce(d["notable_quotes"], F.array().cast("array<string>")), " / ")
    one = lambda d: _lines(
        _if_text(d["employer"], "Arbeitgeber: ", d["employer"]),
        _if_text(d["period"], "Zeitraum: ", d["period"]),
        _if_text(quotes(d), "Zitate: ", quotes(d)),
        _if_text(d["text"], "Inhalt: ", F.substring(d["text"], 1, chars)),
    )
    blocks = F.transform(F.slice(certificates, 1, 3), one)
    return F.when(F.size(certificates) > 0, F.concat(F.lit("\n\nARBEITSZEUGNISSE:\n"), F.array_join(blocks, "\n---\n"))).otherwise("")


def letter_request(cv_text: Column, certificates: Column, job: str) -> Column:
    """The facts of a letter: CV, certificates, and the position with its defaults."""
    field = lambda name, default: F.coalesce(F.nullif(F.col(f"{job}.{name}"), F.lit("")), F.lit(default))
    return F.concat(
        F.lit("LEBENSLAUF:\n"), F.substring(cv_text, 1, 4000), certificates_text(certificates),
        F.lit("\n\nSTELLE:\nTitel: "), F.col(f"{job}.title"), F.lit("\nOrganisation: "), F.col(f"{job}.organization"),
        F.lit("\nOrt: "), field("location", "nicht angegeben"), F.lit("\nPensum: "), field("pensum", "nicht angegeben"),
        F.lit("\nWarum passend: "), field("reason", ""), F.lit("\nStärken-Match: "), F.coalesce(F.array_join(F.col(f"{job}.highlights"), ", "), F.lit("")),
    )


def by_language(language: Column, german: Column, french: Column) -> Column:
    """French for "fr", German for every other value and for null."""
    return F.when(F.coalesce(language == "fr", F.lit(False)), french).otherwise(german)


def cv_first(docs: Column) -> Column:
    """CVs move to the front; the order is kept otherwise."""
    return F.concat(F.filter(docs, lambda d: d["doc_type"] == "cv"), F.filter(docs, lambda d: d["doc_type"] != "cv"))


def validated(df: DataFrame, required: dict[str, Column]) -> DataFrame:
    """Adds ``rejected``: the name of the first requirement that doesn't hold, or null."""
    reason = F.lit(None).cast("string")
    for name, condition in reversed(required.items()):
        reason = F.when(~F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(reason)
    return df.withColumn("rejected", reason)
