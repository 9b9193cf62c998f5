"""Text expressions. All are native column expressions; nulls follow the rule stated with each function."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a browser has it: ASCII classes plus Unicode separators.
WHITE = r"[\s\p{Z}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank(c: Column | str) -> Column:
    """Null becomes the empty string."""
    return F.coalesce(_col(c), F.lit(""))


def normalize(c: Column | str) -> Column:
    """Lower case; German umlauts and ß spelled out; é è ê à â ç without accents; everything else as it is."""
    s = F.lower(_col(c))
    # fixed values: the spellings that search treats as equal
    for letter, spelled in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        s = F.replace(s, F.lit(letter), F.lit(spelled))
    return F.translate(s, "éèêàâç", "eeeaac")


def search_text(*parts: Column | str) -> Column:
    """Lower-cased parts with single spaces between them; a null part leaves its space."""
    return F.lower(F.concat_ws(" ", *(blank(p) for p in parts)))


def trimmed(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), rf"^{WHITE}+|{WHITE}+$", "")


def squeezed(c: Column | str) -> Column:
    """Runs of white space become one space, none at the ends."""
    return trimmed(F.regexp_replace(_col(c), rf"{WHITE}+", " "))


# The patterns of markup, of shown PDF strings and of slugs, and the lengths that texts are cut to.
SCRIPTS, STYLES, TAGS = r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"<[^>]+>"
PDF_BLOCK, PDF_STRING, PDF_ARRAY, PDF_PART = r"(?s)BT\s(.*?)ET", r"\(([^)]*)\)\s*Tj", r"\[([^\]]*)\]\s*TJ", r"\(([^)]*)\)"
NOT_IN_SLUG = r"[^a-z0-9äöü]"
QUOTAS = {"page": 4000, "cv": 4000, "certificate": 2000, "letter certificate": 1500, "reading": 8000, "stored": 5000, "pdf": 10_000}


def cut(c: Column | str, use: str) -> Column:
    """The first characters of a text, as many as its use allows."""
    return F.substring(_col(c), 1, QUOTAS[use])


def html_to_text(c: Column | str, limit: int | None = QUOTAS["page"]) -> Column:
    """Markup to text: scripts, then styles, then tags go; white space is squeezed; entities stay as they are."""
    s = F.regexp_replace(F.regexp_replace(_col(c), SCRIPTS, ""), STYLES, "")
    s = squeezed(F.regexp_replace(s, TAGS, " "))
    return s if limit is None else F.substring(s, 1, limit)


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once a row, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def pdf_text(content: Column | str, limit: int = 10_000, least: int = 100, run: int = 20) -> Column:
    """Text of uncompressed PDF bytes: the strings of Tj and TJ operators between BT and ET.

    With fewer than ``least`` characters, runs of ``run`` or more readable characters come back instead, a line each; if there
    are none, the strings are used after all. Bytes are read as windows-1252.
    """
    high = bytes(range(0x80, 0xA0)).decode("latin-1")
    read = "".join(c if n in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([n]).decode("cp1252") for n, c in zip(range(0x80, 0xA0), high))

    def strings(block: Column) -> Column:
        shown = F.regexp_extract_all(block, F.lit(PDF_STRING), 1)
        arrays = F.regexp_extract_all(block, F.lit(PDF_ARRAY), 1)
        held = F.filter(arrays, lambda a: a.rlike(PDF_PART))
        return F.concat(shown, F.transform(held, lambda a: F.array_join(F.regexp_extract_all(a, F.lit(PDF_PART), 1), "")))

    def spelled(found: Column) -> Column:
        text = F.array_join(found, " ")
        for pattern, into in ((r"\\n", "\n"), (r"\\r", ""), (r"\\t", " "), (r"\\\(", "("), (r"\\\)", ")")):
            text = F.regexp_replace(text, pattern, into)
        return squeezed(text)

    def shown(raw: Column) -> Column:
        # fixed values: the characters that count as readable
        readable = F.regexp_extract_all(raw, F.lit(r"([\w\s\p{Z}äöüÄÖÜéèêàâçß.,;:!?()\-–/@&]{%d,})" % run), 1)

        def chosen(found: Column) -> Column:
            runs = lambda r: F.when(F.size(r) > 0, F.array_join(r, "\n")).otherwise(spelled(found))
            return F.when(F.length(F.array_join(found, "")) < least, once(readable, runs)).otherwise(spelled(found))

        return once(F.flatten(F.transform(F.regexp_extract_all(raw, F.lit(PDF_BLOCK), 1), strings)), chosen)

    latin = F.decode(_col(content), "ISO-8859-1")
    # only a text that has such bytes pays for their translation, character by character
    raw = once(latin, lambda t: F.when(t.rlike(r"[\x80-\x9f]"), F.translate(t, high, read)).otherwise(t))
    return F.substring(once(raw, shown), 1, limit)


def escape_html(c: Column | str) -> Column:
    """The five characters with a meaning in markup become entities, & first; null becomes the empty string."""
    s = blank(c)
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(raw), F.lit(entity))
    return s


def slug(c: Column | str) -> Column:
    """Lower case; anything but a-z, digits and umlauts becomes a hyphen; single hyphens, none at the ends."""
    s = F.regexp_replace(F.lower(_col(c)), NOT_IN_SLUG, "-")
    return F.regexp_replace(F.regexp_replace(s, r"-+", "-"), r"^-|-$", "")


def host(c: Column | str) -> Column:
    """Host of an address in lower case, empty if there is none."""
    return F.lower(blank(F.try_parse_url(_col(c), F.lit("HOST"))))


def icon_url(c: Column | str, template: str = "https://www.google.com/s2/favicons?domain={}&sz=32") -> Column:
    """The address of a site's icon, empty without a host."""
    before, after = template.split("{}")
    h = host(c)
    return F.when(h == "", "").otherwise(F.concat(F.lit(before), h, F.lit(after)))


def title_head(c: Column | str) -> Column:
    """What stands before the first slash."""
    return F.trim(F.substring_index(_col(c), "/", 1))


def line_breaks(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit("\n"), F.lit("<br>\n"))


def short_mail(c: Column | str, most: int = 20) -> Column:
    """Addresses longer than ``most`` keep two characters less and an ellipsis."""
    c = _col(c)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 2), F.lit("…"))).otherwise(c)
