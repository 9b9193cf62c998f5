"""Labels and display strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandmark.functions.text import escape_html

# Wording and month names of the displayed labels.
MONTHS = {
    "de": ["Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"],
    "fr": ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"],
}
BADGES = {"pensum": "⏱ ", "location": "📍 ", "languages": "🌐 ", "salary_hint": "💰 ", "deadline": "📅 bis "}
DOCUMENT_LABELS = {"cv": "CV", "zeugnis": "Zeugnis"}
DOCUMENT_ICONS = {"cv": "📄", "zeugnis": "📜"}
SAVED_LABELS = {"cv": "CV", "zeugnis": "Arbeitszeugnis"}
OTHER_LABEL, OTHER_ICON = "Dokument", "📎"
UPLOAD_HINT, CV_HINT, COUNTED_HINT = "CV & Arbeitszeugnisse hochladen", "CV wird berücksichtigt", " werden beim Matching berücksichtigt"
LOGIN_HINT = "Melde dich an, um das KI-Matching zu nutzen."
START_HINT = "Erstelle ein Profil und markiere Organisationen mit ⭐ für bessere Ergebnisse."
PROFILE_HINT = "Profil erstellen für genauere Matches."
FRENCH_PLACES = r"(?iu)westschweiz|lausanne|gen[eè]ve|fribourg|neuch[aâ]tel|sion|valais|vaud"


def count_label(n: Column) -> Column:
    return F.when(n >= 12, F.concat(n.cast("string"), F.lit(" Unternehmen"))).when(n >= 5, F.concat(n.cast("string"), F.lit(" Orgs"))).otherwise(n.cast("string"))


def score_bucket(score: Column) -> Column:
    return F.when(score >= 4, "high").when(score >= 3, "mid").otherwise("low")


def stars(score: Column) -> Column:
    """Of five; a score outside 0 to 5 is null."""
    return F.when(score.between(0, 5), F.concat(F.repeat(F.lit("⭐"), score.cast("int")), F.repeat(F.lit("☆"), (5 - score).cast("int"))))


def badges(match: Column) -> Column:
    """Texts of the non-empty fields, in fixed order."""
    found = [F.when(F.coalesce(match[f], F.lit("")) != "", F.concat(F.lit(mark), escape_html(match[f]))) for f, mark in BADGES.items()]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def tags(highlights: Column, concerns: Column) -> Column:
    """Highlights, then concerns; concerns alone aren't shown."""
    none = F.array().cast("array<string>")
    good = F.transform(F.coalesce(highlights, none), lambda x: F.concat(F.lit("✓ "), escape_html(x)))
    bad = F.transform(F.coalesce(concerns, none), lambda x: F.concat(F.lit("⚠ "), escape_html(x)))
    return F.when(F.size(good) > 0, F.concat(good, bad)).otherwise(none)


def time_ago(then: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 60_000_000)
    hours = F.floor(minutes / 60)
    return (
        F.when(minutes < 1, "gerade eben")
        .when(minutes < 60, F.concat(F.lit("vor "), minutes.cast("string"), F.lit(" Min.")))
        .when(hours < 24, F.concat(F.lit("vor "), hours.cast("string"), F.lit(" Std.")))
        .otherwise("vor mehr als einem Tag")
    )


def long_date(day: Column, language: Column) -> Column:
    """Day, month name, year; French for "fr", German for everything else."""
    month = lambda k: F.element_at(F.array(*map(F.lit, MONTHS[k])), F.month(day))
    french = F.coalesce(language == "fr", F.lit(False))
    dot = F.when(french, " ").otherwise(". ")
    return F.concat(F.dayofmonth(day).cast("string"), dot, F.when(french, month("fr")).otherwise(month("de")), F.lit(" "), F.year(day).cast("string"))


def letter_language(place: Column) -> Column:
    """French for places in the west of the country, German for all others and for none."""
    return F.when(F.coalesce(place, F.lit("")).rlike(FRENCH_PLACES), "fr").otherwise("de")


def place(city: Column, canton: Column) -> Column:
    return F.concat_ws(", ", F.nullif(city, F.lit("")), F.nullif(canton, F.lit("")))


def by_kind(kind: Column, table: dict[str, str], other: str) -> Column:
    """The entry for a kind, the other one for every other kind and for null."""
    found = F.lit(other)
    for name, value in table.items():
        found = F.when(kind == name, value).otherwise(found)
    return found


def document_label(kind: Column) -> Column:
    return by_kind(kind, DOCUMENT_LABELS, OTHER_LABEL)


def document_icon(kind: Column) -> Column:
    return by_kind(kind, DOCUMENT_ICONS, OTHER_ICON)


def saved_label(kind: Column) -> Column:
    """The name under which a saved upload is confirmed."""
    return by_kind(kind, SAVED_LABELS, OTHER_LABEL)


def certificate_source(kind: Column, employer: Column, period: Column) -> Column:
    """Employer and period of a certificate; empty for other kinds and without an employer."""
    shown = F.concat(escape_html(employer), F.when(F.coalesce(period, F.lit("")) != "", F.concat(F.lit(" · "), escape_html(period))).otherwise(""))
    return F.when((kind == "zeugnis") & (F.coalesce(employer, F.lit("")) != ""), shown).otherwise("")


def options(choices: dict[str, str], position: Column) -> Column:
    """The choice at a position (from 0) in the displayed order, as a struct of key and label; null beyond the last."""
    return F.get(F.array(*(F.struct(F.lit(k).alias("key"), F.lit(v).alias("label")) for k, v in choices.items())), position)


def document_hint(logged_in: Column, has_cv: Column, certificates: Column) -> Column:
    """What is said about uploaded documents; nothing while logged out."""
    plural = F.when(certificates > 1, "se").otherwise("")
    both = F.concat(F.lit("CV + "), certificates.cast("string"), F.lit(" Arbeitszeugnis"), plural, F.lit(COUNTED_HINT))
    return F.when(~logged_in, "").when(has_cv & (certificates > 0), both).when(has_cv, CV_HINT).otherwise(UPLOAD_HINT)


def some_names(names: Column, most: int = 5) -> Column:
    """The first names, and how many more there are."""
    shown = F.array_join(F.slice(names, 1, most), ", ")
    return F.when(F.size(names) > most, F.concat(shown, F.lit(" und "), (F.size(names) - most).cast("string"), F.lit(" weitere"))).otherwise(shown)


def first_names(shown: Column, n: Column) -> Column:
    """The same where only the names to show and the number of all are at hand."""
    names, more = F.array_join(shown, ", "), n - F.size(shown)
    return F.when(more > 0, F.concat(names, F.lit(" und "), more.cast("string"), F.lit(" weitere"))).otherwise(names)


def export_name(organization: Column, now: Column) -> Column:
    """File name of an exported letter."""
    return F.concat(F.lit("Bewerbung_"), F.coalesce(F.nullif(organization, F.lit("")), F.lit("Job")), F.lit("_"), F.date_format(now, "yyyy-MM-dd"))


def profile_hint(logged_in: Column, has_profile: Column, has_favourites: Column) -> Column:
    """What a user is asked to do before matching; nothing once there is a profile."""
    return (
        F.when(~logged_in, LOGIN_HINT)
        .when(~has_profile & ~has_favourites, START_HINT)
        .when(~has_profile, PROFILE_HINT)
        .otherwise("")
    )
