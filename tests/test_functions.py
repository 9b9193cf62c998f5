"""Expressions on the edge cases that the survey lists."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strandmark.functions import labels, text, values
from strandmark.operators import documents, search


def value(spark, c):
    return spark.range(1).select(c.alias("v")).first()["v"]


def many(spark, f, cases, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, x {kind}")
    return [r["v"] for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_normalize(spark):
    assert many(spark, text.normalize, ["Zürich Genève", "Hôpital", "Straße ÄÖ", None]) == ["zuerich geneve", "hôpital", "strasse aeoe", None]
    once = text.normalize(F.lit("Ä é ß Œ"))
    assert value(spark, once) == value(spark, text.normalize(once))


@pytest.mark.parametrize(("query", "hit"), [("", True), ("   ", True), ("bern gesund", True), ("berne", False), ("HEIT", True)])
def test_all_words(spark, query, hit):
    t = F.lit("Gesundheit Bern")
    assert value(spark, search.all_words(t, query)) is hit
    assert value(spark, search.all_words_of(t, F.lit(query))) is hit


def test_all_words_null(spark):
    none = F.lit(None).cast("string")
    assert value(spark, search.all_words(none, "")) is True
    assert value(spark, search.all_words(none, "x")) is False
    assert value(spark, search.all_words_of(none, F.lit("x"))) is False
    assert value(spark, search.any_location(none, ["x"])) is False and value(spark, search.any_location(none, [])) is True


def test_html_to_text(spark):
    cases = ["a<SCRIPT>x</script >b", "&amp;", "<style>p{}</style><p>  a\n b</p>", "a<script>1</script>b", None, "<b", "x" * 5000]
    assert many(spark, text.html_to_text, cases) == ["a x b", "&amp;", "a b", "ab", None, "<b", "x" * 4000]


def test_slug(spark):
    assert many(spark, text.slug, ["Spitäler & Kliniken", "É", "--a--", "a/b/c"]) == ["spitäler-kliniken", "", "a", "a-b-c"]


def test_hosts(spark):
    assert many(spark, text.host, ["https://Www.Example.org:80/a", "nonsense", None]) == ["www.example.org", "", ""]
    assert many(spark, text.icon_url, ["https://a.ch/x", ""]) == ["https://www.google.com/s2/favicons?domain=a.ch&sz=32", ""]


def test_pdf(spark):
    long = b"(" + b"abcdefghi " * 12 + b") Tj"
    cases = [b"BT (Hello) Tj ET", b"BT " + long + b" [(x) -2 (y)] TJ ET", b"", b"some readable words that go on and on \x00 BT (a) Tj ET"]
    got = many(spark, text.pdf_text, cases, "binary")
    assert got[0] == "Hello" and got[1] == ("abcdefghi " * 12 + " xy").replace("  ", " ") and got[2] == ""
    assert got[3].startswith("some readable words")
    assert many(spark, text.pdf_text, [b"BT (10 \x80 \x96 \x84x\x93 \x81) Tj ET"], "binary") == ["10 € – „x“ \x81"]


def test_escape(spark):
    assert many(spark, text.escape_html, ["<a href=\"x\">'&amp;'</a>", None]) == ["&lt;a href=&quot;x&quot;&gt;&#39;&amp;amp;&#39;&lt;/a&gt;", ""]
    assert many(spark, text.short_mail, ["a@b.ch", "averyveryverylong@mail.example"]) == ["a@b.ch", "averyveryverylong@…"]
    assert many(spark, text.title_head, ["Umwelt / Natur", "x"]) == ["Umwelt", "x"]
    assert many(spark, text.line_breaks, ["a\nb"]) == ["a<br>\nb"]


def test_labels(spark):
    assert many(spark, labels.count_label, [4, 5, 11, 12], "int") == ["4", "5 Orgs", "11 Orgs", "12 Unternehmen"]
    assert many(spark, labels.score_bucket, [2, 3, 4], "int") == ["low", "mid", "high"]
    assert many(spark, labels.stars, [0, 3, 5, 6, -1], "int") == ["☆☆☆☆☆", "⭐⭐⭐☆☆", "⭐⭐⭐⭐⭐", None, None]
    assert many(spark, labels.letter_language, [None, "Sion", "Bern", "GENÈVE"]) == ["de", "fr", "de", "fr"]
    assert many(spark, labels.document_label, ["cv", "zeugnis", "x"]) == ["CV", "Zeugnis", "Dokument"]
    assert value(spark, labels.place(F.lit("Bern"), F.lit(""))) == "Bern" and value(spark, labels.place(F.lit("Bern"), F.lit("BE"))) == "Bern, BE"
    hint = lambda *x: value(spark, labels.document_hint(*map(F.lit, x)))
    assert hint(False, True, 1) == "" and hint(True, True, 2).startswith("CV + 2 Arbeitszeugnisse") and hint(True, True, 0).startswith("CV wird")


def test_profile_hint(spark):
    hint = lambda *x: value(spark, labels.profile_hint(*map(F.lit, x)))
    assert hint(False, True, True).startswith("Melde dich an") and hint(True, False, False).startswith("Erstelle") and hint(True, False, True).startswith("Profil erstellen") and hint(True, True, False) == ""


def test_time_ago(spark):
    now = datetime(2024, 5, 1, 12)
    ages = [timedelta(seconds=59), timedelta(seconds=60), timedelta(minutes=59), timedelta(minutes=60), timedelta(hours=24)]
    got = many(spark, lambda x: labels.time_ago(x, F.lit(now)), [now - a for a in ages], "timestamp")
    assert got == ["gerade eben", "vor 1 Min.", "vor 59 Min.", "vor 1 Std.", "vor mehr als einem Tag"]


def test_dates(spark):
    day = F.lit("2024-03-01").cast("date")
    assert value(spark, labels.long_date(day, F.lit("de"))) == "1. März 2024"
    assert value(spark, labels.long_date(day, F.lit("fr"))) == "1 mars 2024"
    assert value(spark, labels.export_name(F.lit(""), F.lit(datetime(2024, 3, 1)))) == "Bewerbung_Job_2024-03-01"


def test_tags_and_badges(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    assert value(spark, labels.tags(a(), a("c"))) == [] and value(spark, labels.tags(a("h"), a("c"))) == ["✓ h", "⚠ c"]
    match = F.struct(F.lit("80%").alias("pensum"), F.lit("").alias("location"), F.lit(None).cast("string").alias("languages"), F.lit("<").alias("salary_hint"), F.lit("1.1.").alias("deadline"))
    assert value(spark, labels.badges(match)) == ["⏱ 80%", "💰 &lt;", "📅 bis 1.1."]


def test_reply(spark):
    r = values.reply(F.lit("not json"))
    assert value(spark, r["summary"]) == "not json" and value(spark, r["matches"]) == [] and value(spark, r["tips"]) == ""
    good = values.reply(F.lit('{"matches":[{"title":"t","score":4}],"summary":"s","tips":"x"}'))
    assert value(spark, good["matches"])[0]["score"] == 4 and value(spark, good["summary"]) == "s"


def test_defaults(spark):
    assert many(spark, lambda x: values.or_default(x, 50), [0, None, 7], "int") == [50, 50, 7]
    assert many(spark, lambda x: values.or_default(x, "d"), ["", None, "v"]) == ["d", "d", "v"]
    assert many(spark, lambda x: values.if_null(x, "d"), ["", None]) == ["", "d"]
    assert many(spark, values.json_list, ['["a"]', "broken", None]) == [["a"], [], []]


def test_sets(spark):
    a = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    once = values.toggled(a("x"), F.lit("y"))
    assert value(spark, once) == ["x", "y"] and value(spark, values.toggled(once, F.lit("y"))) == ["x"]
    assert value(spark, values.toggled(once, F.lit("alle"))) == []
    assert value(spark, values.exclusive(a("x", "*"))) == ["*"] and value(spark, values.exclusive(a("x"))) == ["x"]
    assert value(spark, values.without_position(a("x", "y"), F.lit(0))) == ["y"]
    assert value(spark, values.at_position(a("x"), F.lit(3))) is None
    m = values.merged(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")), F.create_map(F.lit("b"), F.lit("3")))
    assert value(spark, m) == {"a": "1", "b": "3"} and value(spark, values.map_text(m)) == "A: 1, B: 3"
    low, high = values.clamp_workload(F.lit(80), F.lit(60), "high")
    assert (value(spark, low), value(spark, high)) == (60, 60)


def test_form(spark):
    form = values.form_record({"education": F.lit("x")}, {"keywords": F.lit("  a b ")}, F.create_map(F.lit("de"), F.lit("C1"), F.lit("fr"), F.lit("")))
    got = value(spark, form)
    assert got["keywords"] == "a b" and got["languages"] == {"de": "C1"}


DOC = "struct<doc_type:string,raw_text:string,employer:string,period:string,text:string,notable_quotes:array<string>>"


def test_documents_text(spark):
    rows = [("zeugnis", "z1", "Firma", "2020", "t1", ["a", "b"]), ("cv", "lebenslauf", None, None, None, None), ("zeugnis", "", "leer", None, "", None), ("zeugnis", "z2", None, None, "t2", None), ("cv", "second", None, None, None, None)]
    df = spark.createDataFrame([(rows,), ([],)], f"docs array<{DOC}>")
    full, none = [r[0] for r in df.select(documents.documents_text(F.col("docs"))).collect()]
    assert full == "\n\nLEBENSLAUF:\nlebenslauf\n\n\nARBEITSZEUGNISSE:\n--- Firma (2020) ---\nz1\n--- Arbeitszeugnis ---\nz2" and none == ""
    letters = df.select(documents.certificates_text(F.filter("docs", lambda d: d["doc_type"] == "zeugnis"))).first()[0]
    assert letters == "\n\nARBEITSZEUGNISSE:\nArbeitgeber: Firma\nZeitraum: 2020\nZitate: a / b\nInhalt: t1\n---\nArbeitgeber: leer\n---\nInhalt: t2"
    assert [d["raw_text"] for d in df.select(documents.cv_first(F.col("docs"))).first()[0]] == ["lebenslauf", "second", "z1", "", "z2"]


def test_letter_request(spark):
    job = "struct<title:string,organization:string,location:string,pensum:string,reason:string,highlights:array<string>>"
    df = spark.createDataFrame([("cv text", [], ("T", "O", "", None, None, ["h1", "h2"]))], f"cv string, certs array<{DOC}>, job {job}")
    got = df.select(documents.letter_request(F.col("cv"), F.col("certs"), "job")).first()[0]
    assert got == "LEBENSLAUF:\ncv text\n\nSTELLE:\nTitel: T\nOrganisation: O\nOrt: nicht angegeben\nPensum: nicht angegeben\nWarum passend: \nStärken-Match: h1, h2"
    assert value(spark, documents.by_language(F.lit(None).cast("string"), F.lit("de"), F.lit("fr"))) == "de"


def test_empty_profile(spark):
    df = spark.createDataFrame([(None,) * 10], "education string, field_of_study string, experience string, desired_regions array<string>, workload_min int, workload_max int, languages map<string,string>, keywords string, exclusions array<string>, exclusions_freetext string").withColumn("start_date", F.lit(""))
    assert df.select(documents.profile_text()).first()[0] == documents.NO_PROFILE


def test_validation(spark):
    df = spark.createDataFrame([("n", "u"), ("", "u"), ("n", None)], "name string, url string")
    got = documents.validated(df, {"name": F.col("name") != "", "url": F.col("url") != ""})
    assert [r["rejected"] for r in got.collect()] == [None, "name", "url"]


def test_variants(spark):
    from strandmark.functions import variants

    texts = ['{"a": 1, "b c": "x", "it\'s": [1, 2]}', '{"a": "s", "d": 1.5}', "[1]", "7", "null", "{", None]
    df = spark.createDataFrame([(t, "own") for t in texts], "j string, D string").withColumn("v", variants.parsed(F.col("j")))
    schema = variants.found_schema(df, "v")
    assert sorted(schema.names) == ["a", "b c", "d", "it's"]
    wide = variants.expanded(df, "v")
    assert wide.columns == ["j", "D", "v", *(n for n in schema.names if n != "d")]
    rows = wide.collect()
    assert [r["b c"] for r in rows] == ["x"] + [None] * 6 and rows[0]["it's"] == [1, 2] and [r["D"] for r in rows] == ["own"] * 7
    assert [r[0] for r in df.select(variants.as_json(F.col("v"))).collect()] == ['{"a":1,"b c":"x","it\'s":[1,2]}', '{"a":"s","d":1.5}', "[1]", "7", "null", None, None]
    assert variants.found_schema(df.filter("j = '7'"), "v").names == [] and variants.expanded(df.filter("false"), "v").columns == ["j", "D", "v"]
