"""Queries over texts: extraction, search keys, labels, assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmark.functions import labels, text, values, variants
from strandmark.operators import counts, documents, joins, search, sync, trigrams
from strandmark.plans.registry import query
from strandmark.sources import sinks
from strandmark.sources.folders import fresh_folder
from strandmark.sources.tables import table

NORMALIZED = "translate(replace(replace(replace(replace(lower({}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), 'éèêàâç', 'eeeaac')"
STRIP = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[\s\p{{Z}}]+', ' ', 'g'), '^ +', ''), ' +$', ''), '^$', '')"
PLAIN = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '(?is)<style.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g')"


@query(f"SELECT page_id, substr({STRIP.format(PLAIN)}, 1, 4000) AS page_text FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages", ["page_id", "html"]).select("page_id", text.html_to_text("html").alias("page_text"))


@query(f"SELECT doc_id, {NORMALIZED.format('text')} AS normalized FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", text.normalize("text").alias("normalized"))


@query(f"SELECT doc_id, lang FROM documents WHERE contains({NORMALIZED.format('text')}, 'und') AND contains({NORMALIZED.format('text')}, 'ueb')")
def all_words_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", ["doc_id", "lang", "text"])
    return docs.filter(search.all_words(F.col("text"), " Und  üb ")).select("doc_id", "lang")


#: One word, several, one with a rare beginning, one that no text has, short ones alone and beside long ones, umlauts, and none.
SEARCHES = ["heiten", " Und  üb ", "worthless thouinor", "zzqxy", "ab", "a für", "été les", "einenSCHUNG", "", "ciónas que @"]


@query(
    f"""SELECT CAST(i - 1 AS INTEGER) AS query, doc_id FROM (SELECT doc_id, {NORMALIZED.format("coalesce(text, '')")} AS t FROM documents), (SELECT unnest(range(1, {len(SEARCHES) + 1})) AS i),
    LATERAL (SELECT list_filter(regexp_split_to_array({NORMALIZED.format("[" + ", ".join(f"'{q}'" for q in SEARCHES) + "][i]")}, '[\\s\\p{{Z}}]+'), lambda w: w <> '') AS ws) WHERE len(list_filter(ws, lambda w: NOT contains(t, w))) = 0"""
)
def indexed_words_search(spark, sf_dir):
    """Ten searches by an index of trigrams, which is built first."""
    index = trigrams.build_index(table(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text", fresh_folder(spark, "index"))
    return trigrams.search(index, SEARCHES)


@query(
    f"""SELECT doc_id FROM (SELECT doc_id, {NORMALIZED.format('text')} AS t, list_filter(regexp_split_to_array({NORMALIZED.format("CASE lang WHEN 'en' THEN 'The  And' WHEN 'de' THEN 'und für' WHEN 'fr' THEN 'les été' ELSE '' END")}, '[\\s\\p{{Z}}]+'), lambda w: w <> '') AS ws FROM documents)
    WHERE len(list_filter(ws, lambda w: NOT contains(t, w))) = 0"""
)
def all_words_by_column(spark, sf_dir):
    """Each text is asked for two words of its language, which only some have; other languages ask for nothing."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    asked = F.when(F.col("lang") == "en", "The  And").when(F.col("lang") == "de", "und für").when(F.col("lang") == "fr", "les été").otherwise("")
    return docs.filter(search.all_words_of(F.col("text"), asked)).select("doc_id")


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages")
def escape_html(spark, sf_dir):
    return table(spark, sf_dir, "pages", ["page_id", "html"]).select("page_id", text.escape_html("html").alias("escaped"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(lower(text), '[^a-z0-9äöü]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM documents")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", text.slug("text").alias("slug"))


@query(
    r"""SELECT page_id, h AS host, CASE WHEN h = '' THEN '' ELSE 'https://www.google.com/s2/favicons?domain=' || h || '&sz=32' END AS icon
    FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS h FROM pages)"""
)
def url_host(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", ["page_id", "url"])
    return pages.select("page_id", text.host("url").alias("host"), text.icon_url("url").alias("icon"))


@query(
    """SELECT p_partkey, p_size % 6 AS score, CASE WHEN p_size % 6 >= 4 THEN 'high' WHEN p_size % 6 >= 3 THEN 'mid' ELSE 'low' END AS bucket,
    repeat('⭐', p_size % 6) || repeat('☆', 5 - p_size % 6) AS stars FROM part"""
)
def score_labels(spark, sf_dir):
    score = F.col("p_size") % 6
    return table(spark, sf_dir, "part", ["p_partkey", "p_size"]).select("p_partkey", score.alias("score"), labels.score_bucket(score).alias("bucket"), labels.stars(score).alias("stars"))


NOW = "2024-01-31 00:00:00"


@query(
    f"""SELECT event_id, CASE WHEN m < 1 THEN 'gerade eben' WHEN m < 60 THEN 'vor ' || m || ' Min.' WHEN m // 60 < 24 THEN 'vor ' || (m // 60) || ' Std.' ELSE 'vor mehr als einem Tag' END AS ago
    FROM (SELECT event_id, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) // 60000000 AS m FROM events)"""
)
def time_ago(spark, sf_dir):
    now = F.lit(NOW).cast("timestamp_ntz")
    return table(spark, sf_dir, "events", ["event_id", "ts"]).select("event_id", labels.time_ago(F.col("ts"), now).alias("ago"))


def _months(language: str) -> str:
    return "[" + ", ".join(f"'{m}'" for m in labels.MONTHS[language]) + "]"


@query(
    f"""SELECT event_id, day(ts) || '. ' || {_months("de")}[month(ts)] || ' ' || year(ts) AS german, day(ts) || ' ' || {_months("fr")}[month(ts)] || ' ' || year(ts) AS french FROM events"""
)
def long_date(spark, sf_dir):
    day = F.col("ts")
    return table(spark, sf_dir, "events", ["event_id", "ts"]).select("event_id", labels.long_date(day, F.lit("de")).alias("german"), labels.long_date(day, F.lit("fr")).alias("french"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events", ["event_id", "props"]).select("event_id", F.from_json("props", "k long")["k"].alias("k"))


_MIXED = """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN '{"k":"' || event_type || '"}' WHEN 2 THEN '{"k":{"n":' || user_id || ',"t":"' || event_type || '"}}' WHEN 3 THEN '{"k":["a",' || user_id || ']}'
    WHEN 4 THEN '{"k":"' || user_id || '","z":null}' ELSE '{"k":' END"""


@query(
    f"""SELECT event_id, CASE WHEN json_valid(j) THEN TRY_CAST(json_extract_string(j, '$.k') AS BIGINT) END AS number, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.k') END AS said,
    CASE WHEN json_valid(j) THEN CAST(json_extract_string(j, '$.k.n') AS BIGINT) END AS inner_number, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.k[1]') END AS second FROM (SELECT event_id, {_MIXED} AS j FROM events)"""
)
def variant_fields(spark, sf_dir):
    """One field that is a number, a text, an object, an array, a number as text, or part of broken JSON."""
    events, k, user = table(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "props"]), F.col("event_id") % 6, F.col("user_id").cast("string")
    mixed = (
        F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit('{"k":"'), "event_type", F.lit('"}'))).when(k == 2, F.to_json(F.struct(F.struct(F.col("user_id").alias("n"), F.col("event_type").alias("t")).alias("k"))))
        .when(k == 3, F.concat(F.lit('{"k":["a",'), user, F.lit("]}"))).when(k == 4, F.concat(F.lit('{"k":"'), user, F.lit('","z":null}'))).otherwise('{"k":')
    )
    read = events.select("event_id", variants.parsed(mixed).alias("v"))
    at = lambda path, kind: variants.field(F.col("v"), path, kind)
    return read.select("event_id", at("$.k", "bigint").alias("number"), at("$.k", "string").alias("said"), at("$.k.n", "bigint").alias("inner_number"), at("$.k[1]", "string").alias("second"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 3 > 0 THEN event_type END AS kind, CAST(CASE WHEN event_id % 3 > 0 THEN json_object('u', user_id) END AS VARCHAR) AS who FROM events")
def variant_columns(spark, sf_dir):
    """Columns by the schema that the rows turn out to have; no row has all of the fields."""
    events = table(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "props"])
    even, most = F.col("event_id") % 2 == 0, F.col("event_id") % 3 > 0
    stored = F.to_json(F.struct(F.when(even, F.from_json("props", "k bigint")["k"]).alias("k"), F.when(most, F.col("event_type")).alias("kind"), F.when(most, F.struct(F.col("user_id").alias("u"))).alias("who")))
    found = variants.expanded(events.select("event_id", variants.parsed(stored).alias("v")), "v")
    return found.select("event_id", "k", "kind", F.to_json("who").alias("who"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 AND c_nationkey >= 5 THEN '{"jobs":[{"n":' || c_nationkey || ',"title":"' || c_mktsegment || '"}],"total":1}' WHEN c_custkey % 4 > 0 THEN 'live ' || c_name END AS content FROM customer"""
)
def cached_pages(spark, sf_dir):
    """Cached JSON, kept as a variant in a table, goes out as it came in while it is valid, with or without an address; else the live text."""
    customers = table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    jobs = F.struct(F.array(F.struct(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("title"))).alias("jobs"), F.lit(1).alias("total"))
    path = fresh_folder(spark, "cache")
    sinks.append(customers.filter("c_custkey % 3 = 1").select(F.col("c_custkey").alias("key"), variants.parsed(F.to_json(jobs)).alias("extracted"), F.col("c_nationkey").alias("expires")), path)
    cache = spark.read.parquet(path)
    found = joins.valid_cache(customers.withColumnRenamed("c_custkey", "key"), cache, "key", "expires", F.lit(5))
    content = documents.page_content(variants.as_json(F.col("extracted")), F.concat(F.lit("live "), "c_name"), F.when(F.col("key") % 4 > 0, "u").otherwise(""))
    return found.select(F.col("key").alias("c_custkey"), content.alias("content"))


@query(
    """SELECT event_id, CASE WHEN event_id % 3 = 1 THEN user_id % 4 ELSE 0 END AS n_matches, CASE WHEN event_id % 3 = 0 THEN 'Text ' || props WHEN event_id % 3 = 1 THEN event_type END AS summary,
    CASE WHEN event_id % 3 = 0 THEN '' END AS tips, CASE WHEN event_id % 3 = 1 AND user_id % 4 > 0 THEN 'Stelle ' || user_id END AS first_title FROM events"""
)
def tolerant_reply(spark, sf_dir):
    """A third of the replies isn't JSON, a third has a summary and up to three matches, a third nothing that is known."""
    match = F.struct(F.concat(F.lit("Stelle "), F.col("user_id").cast("string")).alias("title"), (F.col("event_id") % 6).cast("int").alias("score"))
    said = F.struct(F.col("event_type").alias("summary"), F.array_repeat(match, (F.col("user_id") % 4).cast("int")).alias("matches"))
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Text "), "props")).when(F.col("event_id") % 3 == 1, F.to_json(said)).otherwise(F.col("props"))
    r = values.reply(raw)
    found = counts.result_count(r["matches"]).cast("long").alias("n_matches"), r["summary"].alias("summary"), r["tips"].alias("tips"), F.get(r["matches"], 0)["title"].alias("first_title")
    return table(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "props"]).select("event_id", *found)


@query(
    """SELECT c_custkey, array_to_string(list_filter([
      'Ausbildung: ' || c_mktsegment, CASE WHEN c_nationkey % 2 = 0 THEN 'Berufserfahrung: ' || c_nationkey || ' Jahre' END,
      CASE WHEN c_nationkey % 3 = 0 THEN 'Gewünschte Regionen: Nord, Süd' END, CASE WHEN c_nationkey > 0 THEN 'Pensum: ' || c_nationkey || '% – 100%' END,
      CASE WHEN c_nationkey % 5 = 0 THEN 'Sprachen: DE: gut, FR: ' || c_name END, 'Stichwörter: ' || c_name], lambda x: x IS NOT NULL), chr(10)) AS profile FROM customer"""
)
def profile_text(spark, sf_dir):
    key = F.col("c_nationkey")
    none, no_map = F.array().cast("array<string>"), F.create_map().cast("map<string,string>")
    p = F.struct(
        F.col("c_mktsegment").alias("education"), F.lit("").alias("field_of_study"), F.when(key % 2 == 0, key.cast("string")).alias("experience"),
        F.when(key % 3 == 0, F.array(F.lit("Nord"), F.lit("Süd"))).otherwise(none).alias("desired_regions"), key.alias("workload_min"), F.lit(0).alias("workload_max"),
        F.when(key % 5 == 0, F.create_map(F.lit("fr"), F.col("c_name"), F.lit("de"), F.lit("gut"))).otherwise(no_map).alias("languages"), F.col("c_name").alias("keywords"),
        F.lit(None).cast("array<string>").alias("exclusions"), F.lit(None).cast("string").alias("exclusions_freetext"), F.lit("").alias("start_date"),
    )
    # a workload without any bound is left out
    rows = table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    return rows.select("c_custkey", p.alias("p")).select("c_custkey", documents.profile_text("p").alias("profile"))


@query(
    """WITH t AS (SELECT conv_id, turn, text, CASE WHEN role = 'user' THEN 'cv' ELSE 'zeugnis' END AS kind FROM conversations),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, kind ORDER BY turn) AS i FROM t WHERE text <> ''),
    c AS (SELECT conv_id, max(CASE WHEN kind = 'cv' AND i = 1 THEN chr(10) || chr(10) || 'LEBENSLAUF:' || chr(10) || substr(text, 1, 4000) END) AS cv,
      string_agg('--- Arbeitszeugnis ---' || chr(10) || substr(text, 1, 2000), chr(10) ORDER BY turn) FILTER (WHERE kind = 'zeugnis' AND i <= 3) AS z FROM n GROUP BY conv_id)
    SELECT conv_id, concat_ws(chr(10), cv, CASE WHEN z IS NOT NULL THEN chr(10) || chr(10) || 'ARBEITSZEUGNISSE:' || chr(10) || z END) AS context FROM c"""
)
def first_k_context(spark, sf_dir):
    """Users' turns stand for CVs, the others for certificates. Rows past the quota go before texts are gathered."""
    kind = F.when(F.col("role") == "user", "cv").otherwise("zeugnis")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("raw_text"), kind.alias("doc_type")).filter("raw_text <> ''")
    kept = sync.first_k(turns, ["conv_id", "doc_type"], ["turn"], 3)
    doc = F.struct("turn", "doc_type", "raw_text", F.lit(None).cast("string").alias("employer"), F.lit(None).cast("string").alias("period"))
    held = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(doc)).alias("docs"))
    return held.select("conv_id", documents.documents_text(F.col("docs")).alias("context"))


@query(
    """SELECT n_regionkey, string_agg('--- ' || i || '. ' || n_name || ' (' || CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE 'u' || n_nationkey END || ') ---' || chr(10) || c, chr(10) || chr(10) ORDER BY i) AS pages_text
    FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM (SELECT *, CASE WHEN n_nationkey % 3 = 1 THEN 'cached' WHEN n_nationkey % 4 = 0 THEN NULL ELSE 'live' END AS c FROM nation) WHERE c IS NOT NULL) GROUP BY n_regionkey"""
)
def page_blocks(spark, sf_dir):
    """Cached text before live text, even without an address; a nation that has neither isn't numbered."""
    key = F.col("n_nationkey")
    url = F.when(key % 4 != 0, F.concat(F.lit("u"), key.cast("string"))).otherwise("")
    content = documents.page_content(F.when(key % 3 == 1, "cached"), F.lit("live"), url)
    pages = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", "n_name", url.alias("url"), content.alias("content"))
    return documents.page_blocks(pages, ["n_regionkey"], "n_nationkey", "n_name", "url", "content")


@query(
    """SELECT n_regionkey, CASE WHEN n > 3 THEN array_to_string(names[1:3], ', ') || ' und ' || (n - 3) || ' weitere' ELSE array_to_string(names, ', ') END AS shown
    FROM (SELECT n_regionkey, count(*) AS n, list(n_name ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey)"""
)
def some_names(spark, sf_dir):
    """Only the names that are shown are gathered; the rest is a count."""
    nations = table(spark, sf_dir, "nation", ["n_regionkey", "n_nationkey", "n_name"])
    shown = sync.first_k(nations, ["n_regionkey"], ["n_nationkey"], 3).groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n", "n_name"))).alias("a"))
    joined = shown.join(counts.count_by(nations, "n_regionkey"), "n_regionkey")
    return joined.select("n_regionkey", labels.first_names(F.transform("a", lambda x: x["n_name"]), F.col("n")).alias("shown"))


@query("SELECT s_suppkey, greatest(s_nationkey, 10) AS high, least(s_nationkey, 10) AS low, CASE WHEN s_nationkey = 0 THEN 50 ELSE s_nationkey END AS workload_min FROM supplier")
def workload_bounds(spark, sf_dir):
    key = F.col("s_nationkey")
    _, high = values.clamp_workload(key, F.lit(10), "low")
    low, _ = values.clamp_workload(key, F.lit(10), "high")
    return table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"]).select("s_suppkey", high.alias("high"), low.alias("low"), values.or_default(key, 50).alias("workload_min"))


PLACES = ["Bern", "Sion", "Lausanne VD", "GENÈVE", "Zürich", "Neuchatel", "Westschweiz", None]


@query(
    f"""SELECT n_nationkey, p AS place, CASE WHEN regexp_matches(coalesce(p, ''), '(?i){labels.FRENCH_PLACES.removeprefix("(?iu)")}') THEN 'fr' ELSE 'de' END AS language
    FROM (SELECT n_nationkey, [{", ".join("NULL" if x is None else f"'{x}'" for x in PLACES)}][1 + n_nationkey % {len(PLACES)}] AS p FROM nation)"""
)
def letter_language(spark, sf_dir):
    place = F.get(F.array(*map(F.lit, PLACES)), F.col("n_nationkey") % len(PLACES)).alias("place")
    return table(spark, sf_dir, "nation", ["n_nationkey"]).select("n_nationkey", place).withColumn("language", labels.letter_language(F.col("place")))
