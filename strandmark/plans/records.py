"""Queries over records as a directory keeps them: sources and sinks, policies, checks, arrays, labels and letters.

Driver tables stand in: customers for organisations and profiles, events for rows that users own, conversations for documents.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmark.functions import labels, text, values
from strandmark.operators import counts, documents, joins, policy, search, sync
from strandmark.plans.registry import query
from strandmark.plans.texts import PLAIN, STRIP
from strandmark.sources import files, sinks, tables
from strandmark.sources.folders import fresh_folder
from strandmark.sources.tables import table

NO_TEXTS = "array<string>"


def _customers(spark, sf_dir, *columns: str):
    return table(spark, sf_dir, "customer", [*columns])


@query("SELECT r_name AS category, r_regionkey AS category_pos, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS org_pos, n_nationkey AS id, n_name AS loc FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey <> 2")
def flattened_categories(spark, sf_dir):
    """Regions with their nations as a nested array, flattened again; one region's array is empty and gives no row."""
    nations = table(spark, sf_dir, "nation").filter("n_regionkey <> 2").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("loc")))).alias("orgs"))
    nested = table(spark, sf_dir, "region").join(nations, "r_regionkey", "left").select(F.col("r_name").alias("key"), F.col("r_regionkey").alias("category_pos"), F.coalesce("orgs", F.array().cast(nations.schema["orgs"].dataType)).alias("orgs"))
    return tables.flattened(nested)


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 2 WHEN c_custkey % 4 = 1 THEN 1 ELSE 0 END AS n, CASE WHEN c_custkey % 4 = 0 THEN 'a' WHEN c_custkey % 4 = 1 THEN c_name END AS first FROM customer")
def stored_lists(spark, sf_dir):
    """Stored lists as JSON: two entries, one, text that isn't JSON, and none at all."""
    k = F.col("c_custkey") % 4
    stored = F.when(k == 0, '["a", "b"]').when(k == 1, F.to_json(F.array("c_name"))).when(k == 2, "[broken")
    found = values.json_list(stored)
    return _customers(spark, sf_dir, "c_custkey", "c_name").select("c_custkey", F.size(found).alias("n"), F.get(found, 0).alias("first"))


@query(
    f"""SELECT page_id, CASE WHEN page_id % 5 = 0 THEN NULL WHEN page_id % 5 = 1 THEN '(Karriereseite konnte nicht geladen werden)' WHEN page_id % 5 = 2 THEN NULL ELSE substr({STRIP.format(PLAIN)}, 1, 4000) END AS content FROM pages"""
)
def live_pages(spark, sf_dir):
    """Every fifth page has no address, every fifth an error, every fifth the status 404."""
    k = F.col("page_id") % 5
    pages = table(spark, sf_dir, "pages", ["page_id", "url", "html"]).withColumns({"url": F.when(k != 0, F.col("url")), "error": F.when(k == 1, "timeout"), "status": F.when(k == 2, 404).otherwise(200)})
    return tables.live_pages(pages).select("page_id", "content")


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey = 7")
def single_row(spark, sf_dir):
    return tables.single(_customers(spark, sf_dir, "c_custkey", "c_name", "c_mktsegment"), "c_custkey", 7)


@query("SELECT c_custkey, c_mktsegment AS education, c_name AS keywords, CASE WHEN c_nationkey % 2 = 0 THEN 'DE: ' || c_nationkey ELSE '' END AS languages FROM customer")
def form_record(spark, sf_dir):
    spoken = F.create_map(F.lit("de"), F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey").cast("string")).otherwise(""), F.lit("fr"), F.lit(""))
    record = values.form_record({"education": F.col("c_mktsegment")}, {"keywords": F.concat(F.lit("  "), "c_name", F.lit(" "))}, spoken)
    read = _customers(spark, sf_dir, "c_custkey", "c_name", "c_nationkey", "c_mktsegment").select("c_custkey", record.alias("r"))
    return read.select("c_custkey", "r.education", "r.keywords", values.map_text(F.col("r.languages")).alias("languages"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def appended_rows(spark, sf_dir):
    """Written when the query is made, each time to a new folder, and read when its rows are asked for; so with all queries that write."""
    path, rows = fresh_folder(spark, "appended"), _customers(spark, sf_dir, "c_custkey", "c_name", "c_mktsegment")
    for segment in ("BUILDING", "MACHINERY"):
        sinks.append(rows.filter(F.col("c_mktsegment") == segment).drop("c_mktsegment"), path)
    return spark.read.parquet(path)


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'MACHINERY'")
def overwritten_rows(spark, sf_dir):
    path, rows = fresh_folder(spark, "overwritten"), _customers(spark, sf_dir, "c_custkey", "c_name", "c_mktsegment")
    for segment in ("BUILDING", "MACHINERY"):
        sinks.overwrite(rows.filter(F.col("c_mktsegment") == segment).drop("c_mktsegment"), path)
    return spark.read.parquet(path)


@query("SELECT c_custkey, unnest(['o' || c_nationkey, c_mktsegment]) AS org_id FROM customer WHERE c_custkey % 3 > 0")
def bulk_favourites(spark, sf_dir):
    """One row for each entry; every third user has an empty list."""
    entries = F.when(F.col("c_custkey") % 3 > 0, F.array(F.concat(F.lit("o"), F.col("c_nationkey").cast("string")), "c_mktsegment")).otherwise(F.array().cast(NO_TEXTS))
    return sync.bulk_rows(_customers(spark, sf_dir, "c_custkey", "c_nationkey", "c_mktsegment").withColumn("favs", entries), "c_custkey", "favs", "org_id")


@query("""SELECT 'user' || c_custkey AS key, '{"name":"' || c_name || '","regions":["' || c_mktsegment || '"]}' AS value FROM customer""")
def stored_values(spark, sf_dir):
    rows = _customers(spark, sf_dir, "c_custkey", "c_name", "c_mktsegment").withColumn("key", F.concat(F.lit("user"), F.col("c_custkey").cast("string")))
    return sinks.stored_values(rows, "key", F.struct(F.col("c_name").alias("name"), F.array("c_mktsegment").alias("regions")))


@query(
    """SELECT conv_id, turn, concat_ws(chr(10), '<!DOCTYPE html>', '<html lang="' || CASE WHEN conv_id % 2 = 0 THEN 'fr' ELSE 'de' END || '">', '<head>', '<meta charset="utf-8">',
      '<title>Bewerbung – ' || CASE WHEN turn % 2 = 0 THEN role || ' &amp; Söhne' ELSE '' END || '</title>', '</head>', '<body>', replace(coalesce(text, ''), chr(10), '<br>' || chr(10)), '</body>', '</html>') AS html,
    'Bewerbung_' || CASE WHEN turn % 2 = 0 THEN role ELSE 'Job' END || '_2024-02-03' AS name FROM conversations"""
)
def letter_export(spark, sf_dir):
    """Letters as HTML, with the names of their files."""
    turns = table(spark, sf_dir, "conversations").withColumn("name", labels.export_name(F.when(F.col("turn") % 2 == 0, F.col("role")).otherwise(""), F.lit("2024-02-03").cast("date")))
    firm = F.when(F.col("turn") % 2 == 0, F.concat("role", F.lit(" & Söhne")))
    return sinks.letters_as_html(turns, "text", F.when(F.col("conv_id") % 2 == 0, "fr").otherwise("de"), firm).select("conv_id", "turn", "html", "name")


_LETTERS = """(SELECT 'Bewerbung_' || CASE WHEN turn % 2 = 0 THEN 'A_B ' || role ELSE 'Job' END || '_2024-02-03' AS stem, row_number() OVER (PARTITION BY turn % 2 = 0, CASE WHEN turn % 2 = 0 THEN role END ORDER BY conv_id, turn) AS i, coalesce(text, '') AS text,
  CASE WHEN turn % 2 = 0 THEN 'A/B ' || role ELSE '' END AS firm FROM conversations)"""


@query(
    f"""SELECT stem || CASE WHEN i > 1 THEN '_' || i ELSE '' END || e AS name, CAST(octet_length(encode(t)) AS BIGINT) AS length, sha256(t) AS sha FROM (SELECT stem, i, '.txt' AS e, text AS t FROM {_LETTERS} UNION ALL
    SELECT stem, i, '.html', concat_ws(chr(10), '<!DOCTYPE html>', '<html lang="de">', '<head>', '<meta charset="utf-8">', '<title>Bewerbung – ' || firm || '</title>', '</head>', '<body>', replace(text, chr(10), '<br>' || chr(10)), '</body>', '</html>') FROM {_LETTERS})"""
)
def letter_files(spark, sf_dir):
    """Letters as files, once as text and once as a page, read back."""
    turns = table(spark, sf_dir, "conversations").withColumn("firm", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("A/B "), "role")).otherwise(""))
    stem, folders, path = labels.export_name(F.col("firm"), F.lit("2024-02-03").cast("date")), files.folders_for(turns), fresh_folder(spark, "letters")
    named = files.file_names(turns, stem, "", ["conv_id", "turn"], path=fresh_folder(spark, "letter_names"))
    files.write_files(named, F.concat("name", F.lit(".txt")), text.blank("text"), path, folders=folders)
    files.write_files(sinks.letters_as_html(named, "text", F.lit("de"), F.col("firm")), F.concat("name", F.lit(".html")), F.col("html"), path, folders=folders)
    return files.read_files(spark, path).select("name", "length", F.sha2("content", 256).alias("sha"))


@query("SELECT 'cv' || c_custkey || '.pdf' AS name, rtrim(repeat(c_name || ' ', CAST(10 + c_custkey % 90 AS INTEGER))) AS text FROM customer WHERE 16 + 19 * (10 + c_custkey % 90) <= 1500")
def pdf_file_texts(spark, sf_dir):
    """PDF files of customers and other files beside them; those that are too large are left out before they are read."""
    rows, path = _customers(spark, sf_dir, "c_custkey", "c_name"), fresh_folder(spark, "uploads")
    shown = F.repeat(F.concat("c_name", F.lit(" ")), (10 + F.col("c_custkey") % 90).cast("int"))
    number = F.concat(F.lit("cv"), F.col("c_custkey").cast("string"))
    folders = files.folders_for(rows)
    files.write_files(rows, F.concat(number, F.lit(".pdf")), F.encode(F.concat(F.lit("%PDF BT ("), shown, F.lit(") Tj ET")), "ISO-8859-1"), path, folders=folders)
    files.write_files(rows.filter("c_custkey % 10 = 0"), F.concat(number, F.lit(".txt")), F.encode(F.lit("BT (x) Tj ET"), "UTF-8"), path, folders=folders)
    return tables.pdf_files(spark, path, 1500).select("name", text.pdf_text("content").alias("text"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS education, CASE WHEN c_custkey % 5 > 0 THEN c_nationkey ELSE 50 END AS workload_min, CASE WHEN c_custkey % 5 > 0 THEN 80 ELSE 100 END AS workload_max FROM customer")
def reset_profiles(spark, sf_dir):
    rows = _customers(spark, sf_dir, "c_custkey", "c_name", "c_nationkey").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("education"), F.col("c_nationkey").alias("workload_min"), F.lit(80).alias("workload_max"))
    return sync.reset(rows, rows.filter("id % 5 = 0"))


@query(
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS education, CASE WHEN c_nationkey = 0 THEN 50 ELSE c_nationkey END AS workload_min, 100 AS workload_max,
    CASE WHEN c_custkey % 3 = 0 THEN 'DE: ' || c_name ELSE '' END AS languages, len(CASE WHEN c_custkey % 5 = 0 THEN ['x'] ELSE [] END) AS regions,
    CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2024-01-05' ELSE TIMESTAMP '2024-02-01' END AS updated_at FROM customer"""
)
def profile_rows(spark, sf_dir):
    """Edited profiles with gaps, as the profile table gets them."""
    k = F.col("c_custkey")
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    edited = _customers(spark, sf_dir, "c_custkey", "c_name", "c_nationkey", "c_mktsegment").select(
        k.alias("id"), F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("education"), F.col("c_nationkey").alias("workload_min"), F.lit(None).cast("int").alias("workload_max"),
        F.when(k % 3 == 0, F.create_map(F.lit("de"), F.col("c_name"))).alias("languages"), F.when(k % 5 == 0, F.array(F.lit("x"))).alias("desired_regions"), F.when(k % 4 == 0, at("2024-01-05")).alias("updated_at"),
    )
    sent = sync.profile_row(edited, at("2024-02-01"))
    return sent.select("id", "education", "workload_min", "workload_max", values.map_text(F.col("languages")).alias("languages"), F.size("desired_regions").cast("long").alias("regions"), "updated_at")


@query(
    """SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.l ELSE o.l END AS languages, o.created FROM (SELECT c_custkey AS id, 'DE: gut' AS l, c_name AS created FROM customer WHERE c_custkey % 2 = 0) o
    FULL JOIN (SELECT user_id AS id, 'FR: ' || max(event_type) AS l FROM events GROUP BY user_id) n ON o.id = n.id"""
)
def upsert_profiles(spark, sf_dir):
    """Profiles have a map of languages; of several writes without an order the greatest row replaces the stored one."""
    stored = _customers(spark, sf_dir, "c_custkey", "c_name").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.create_map(F.lit("de"), F.lit("gut")).alias("languages"), F.col("c_name").alias("created"))
    sent = table(spark, sf_dir, "events", ["user_id", "event_type"]).select(F.col("user_id").alias("id"), F.create_map(F.lit("fr"), F.col("event_type")).alias("languages"))
    return sync.upsert(stored, sent, "id").select("id", values.map_text(F.col("languages")).alias("languages"), "created")


@query("SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 = 0")
def filled_profiles(spark, sf_dir):
    """An education, or a field, or a region; here regions alone count."""
    k = F.col("c_custkey")
    regions = F.when(k % 5 == 0, F.array(F.lit("Bern"))).when(k % 7 == 0, F.array().cast(NO_TEXTS))
    filled = sync.is_filled(F.when(k % 2 == 0, F.col("c_name")).otherwise(""), F.when(k % 3 == 0, F.col("c_name")), F.lit(""), regions)
    return _customers(spark, sf_dir, "c_custkey", "c_name").filter(filled).select("c_custkey")


@query(
    """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'name' WHEN doc_id % 4 = 1 THEN 'url' WHEN length(trim(coalesce(text, ''))) < 50 THEN 'text' END AS rejected FROM documents"""
)
def rejected_entries(spark, sf_dir):
    """The first requirement that an entry misses: a name, an address, a text of 50 characters."""
    k = F.col("doc_id") % 4
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    checks = {"name": given(F.when(k == 0, "").otherwise("x")), "url": given(F.when(k != 1, "u")), "text": F.length(F.trim(text.blank("text"))) >= 50}
    return documents.validated(table(spark, sf_dir, "documents", ["doc_id", "text"]), checks).select("doc_id", "rejected")


def _owned(spark, sf_dir, owner: str):
    events = table(spark, sf_dir, "events", ["event_id", "user_id", "event_type"])
    kind = F.col("event_type")
    return events.select("event_id", F.when(kind != "click", F.col("user_id").cast("string")).alias(owner), F.when(kind != "error", kind == "purchase").alias("approved"))


OWN = "coalesce(event_type <> 'click' AND user_id = 3, false)"


def _policy(name: str, owner: str, select: str, insert: str, update: str, delete: str) -> None:
    """Registers what user 3 may do with each row of a table; clicks have no owner, errors no approval."""

    def of_table(spark, sf_dir):
        allowed = (policy.visible_if(name, F.lit("3"), operation).alias(f"may_{operation}") for operation in ("select", "insert", "update", "delete"))
        return _owned(spark, sf_dir, owner).select("event_id", *allowed)

    of_table.__name__ = f"policy_{name}"
    query(f"SELECT event_id, {select} AS may_select, {insert} AS may_insert, {update} AS may_update, {delete} AS may_delete FROM events")(of_table)


_policy("profiles", "id", OWN, OWN, OWN, "false")
_policy("favorites", "user_id", OWN, OWN, "false", OWN)
_policy("community_categories", "user_id", f"coalesce(event_type = 'purchase', false) OR {OWN}", OWN, "false", "false")
_policy("job_cache", "org_id", "true", "false", "false", "false")
_policy("cv_uploads", "user_id", OWN, OWN, OWN, OWN)
_policy("search_logs", "user_id", "false", f"event_type = 'click' OR {OWN}", "false", "false")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT lpad(CAST(o_orderkey * 7 AS VARCHAR), 6, '0') AS n FROM orders) WHERE contains(c_name, n))")
def near_many_locations(spark, sf_dir):
    """Many picked names: the substring join by trigrams."""
    names = table(spark, sf_dir, "orders", ["o_orderkey"]).select(F.lpad((F.col("o_orderkey") * 7).cast("string"), 6, "0").alias("name"))
    return search.near_locations(_customers(spark, sf_dir, "c_custkey", "c_name"), names, "c_name").select("c_custkey")


@query("SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS n FROM orders UNION SELECT DISTINCT substr(text, 30, 12) FROM benchmark) WHERE contains(text, n))")
def names_in_texts(spark, sf_dir):
    """The same on long texts: numbers of orders, from one digit on, and pieces of other texts."""
    numbers = table(spark, sf_dir, "orders", ["o_orderkey"]).select(F.col("o_orderkey").cast("string").alias("name"))
    names = numbers.union(table(spark, sf_dir, "benchmark").select(F.substring("text", 30, 12)))
    return search.near_locations(table(spark, sf_dir, "documents", ["doc_id", "text"]), names, "text").select("doc_id")


@query("SELECT n_nationkey FROM nation WHERE contains(n_name, '_2') OR contains(n_name, '7')")
def near_few_locations(spark, sf_dir):
    return search.near_locations(table(spark, sf_dir, "nation", ["n_nationkey", "n_name"]), spark.createDataFrame([("_2",), ("7",), ("Bern",)], "name string"), "n_name").select("n_nationkey")


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 'Fehler' WHEN 'view' THEN 'Ansicht' ELSE event_type END AS shown FROM events")
def looked_up_text(spark, sf_dir):
    return table(spark, sf_dir, "events", ["event_id", "event_type"]).select("event_id", joins.looked_up(F.col("event_type"), {"error": "Fehler", "view": "Ansicht"}).alias("shown"))


@query("SELECT conv_id, string_agg(CAST(turn AS VARCHAR), ',' ORDER BY CASE WHEN role = 'assistant' THEN 0 ELSE 1 END, turn) AS turns FROM conversations GROUP BY conv_id")
def cv_first(spark, sf_dir):
    """Assistants' turns stand for CVs."""
    doc = F.struct("turn", F.when(F.col("role") == "assistant", "cv").otherwise("zeugnis").alias("doc_type"))
    held = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(doc)).alias("docs"))
    return held.select("conv_id", F.array_join(F.transform(documents.cv_first(F.col("docs")), lambda d: d["turn"].cast("string")), ",").alias("turns"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '*' ELSE c_name || ',' || c_mktsegment END AS chosen,
    CASE c_custkey % 4 WHEN 0 THEN 'b,c' WHEN 1 THEN 'a,c' WHEN 2 THEN 'a,b' ELSE 'a,b,c' END AS without, CASE c_custkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' END AS element FROM customer"""
)
def array_edits(spark, sf_dir):
    """The item for everything stands alone; an entry taken out by position; an entry by position, null beyond the end."""
    at, letters = (F.col("c_custkey") % 4).cast("int"), F.array(*map(F.lit, "abc"))
    chosen = values.exclusive(F.when(F.col("c_custkey") % 3 == 0, F.array("c_name", F.lit("*"))).otherwise(F.array("c_name", "c_mktsegment")))
    return _customers(spark, sf_dir, "c_custkey", "c_name", "c_mktsegment").select(
        "c_custkey", F.array_join(chosen, ",").alias("chosen"), F.array_join(values.without_position(letters, at), ",").alias("without"), values.at_position(letters, at).alias("element")
    )


@query(
    """SELECT event_id, array_to_string(CASE WHEN event_type = 'error' THEN [] WHEN event_id % 3 = 0 THEN ['click'] ELSE CASE WHEN event_type IN ('click', 'view') THEN list_filter(['click', 'view'], lambda x: x <> event_type) ELSE ['click', 'view', event_type] END END, ',') AS chosen FROM
    (SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_type <> 'error' THEN 'click' ELSE event_type END AS event_type FROM events)"""
)
def toggled_arrays(spark, sf_dir):
    """A click on an item of a kept selection: on, off, or everything off; every third selection is empty before a click."""
    third, kind = F.col("event_id") % 3 == 0, F.col("event_type")
    held = F.when(third, F.array().cast(NO_TEXTS)).otherwise(F.array(F.lit("click"), F.lit("view")))
    item = F.when(kind == "error", "alle").when(third, "click").otherwise(kind)
    return table(spark, sf_dir, "events", ["event_id", "event_type"]).select("event_id", F.array_join(values.toggled(held, item), ",").alias("chosen"))


@query(
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 0 OR coalesce(text, '') = '' THEN 0 ELSE 1 END AS letters, CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN 'd' ELSE role END AS kept, CASE WHEN turn % 4 < 2 THEN 'd' ELSE role END AS filled,
    CASE turn % 4 WHEN 0 THEN 0 WHEN 1 THEN 7 ELSE turn END AS kept_number, CASE WHEN turn % 4 < 2 THEN 7 ELSE turn END AS filled_number FROM conversations"""
)
def counted_letters(spark, sf_dir):
    """A letter counts if it isn't empty; defaults for null alone, and for null, empty and zero."""
    k = F.col("turn") % 4
    said, number = F.when(k == 0, "").when(k > 1, F.col("role")), F.when(k == 0, F.lit(0).cast("long")).when(k > 1, F.col("turn"))
    letter = F.when(F.col("turn") % 3 > 0, text.blank("text")).otherwise("")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", counts.letter_count(letter).alias("letters"), values.if_null(said, "d").alias("kept"), values.or_default(said, "d").alias("filled"),
        values.if_null(number, 7).alias("kept_number"), values.or_default(number, 7).alias("filled_number"),
    )


@query("SELECT c_custkey, 'Preis €' || c_name || ' „x“ yz' AS short, substr(repeat(c_name || ' (a)', 30) || ' ' || c_name, 1, 10000) AS long FROM customer")
def pdf_text(spark, sf_dir):
    """Short strings in bytes of windows-1252 and an array of parts; a long one with escaped brackets."""
    plain = lambda s: F.encode(s if not isinstance(s, str) else F.lit(s), "ISO-8859-1")
    byte = lambda n: F.lit(bytes([n]))
    short = F.concat(plain("%PDF BT (Preis "), byte(0x80), plain(F.col("c_name")), plain(" "), byte(0x84), plain("x"), byte(0x93), plain(") Tj [(y) -3 (z)] TJ ET"))
    body = F.repeat(F.concat("c_name", F.lit(r" \(a\]")), 30)
    long = plain(F.concat(F.lit("BT ("), F.replace(body, F.lit(r"\]"), F.lit("]")), F.lit(") Tj ET BT ("), "c_name", F.lit(") Tj ET")))
    rows = tables.spread(_customers(spark, sf_dir, "c_custkey", "c_name")).select("c_custkey", short.alias("short"), long.alias("long"))
    shown = F.replace(text.pdf_text("long"), F.lit("(a]"), F.lit("(a)"))  # a closing bracket would end the string, so a square one stands for it
    return rows.select("c_custkey", text.pdf_text("short").alias("short"), shown.alias("long"))


@query(
    """SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN '⏱ ' || c_nationkey || '%' END, '📍 ' || c_name || ' &amp; Umgebung', CASE WHEN c_custkey % 3 = 0 THEN '📅 bis ' || c_mktsegment END], lambda x: x IS NOT NULL), '|') AS badges,
    CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN '✓ &lt;b&gt;|⚠ weit' ELSE '✓ &lt;b&gt;' END AS tags FROM customer"""
)
def badges_and_tags(spark, sf_dir):
    """Only non-empty fields have a badge; concerns show only beside highlights."""
    k, none = F.col("c_custkey"), F.array().cast(NO_TEXTS)
    match = F.struct(
        F.when(k % 2 == 0, F.concat(F.col("c_nationkey").cast("string"), F.lit("%"))).alias("pensum"), F.concat("c_name", F.lit(" & Umgebung")).alias("location"),
        F.lit("").alias("languages"), F.lit(None).cast("string").alias("salary_hint"), F.when(k % 3 == 0, F.col("c_mktsegment")).otherwise("").alias("deadline"),
    )
    good = F.when(k % 4 == 0, none).otherwise(F.array(F.lit("<b>")))
    bad = F.when(k % 4 < 2, F.array(F.lit("weit")))
    rows = _customers(spark, sf_dir, "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return rows.select("c_custkey", F.array_join(labels.badges(match), "|").alias("badges"), F.array_join(labels.tags(good, bad), "|").alias("tags"))


@query(
    """SELECT doc_id, trim(split_part(text, '/', 1), ' ') AS head, replace(substr(text, 1, 8000), chr(10), '<br>' || chr(10)) AS read, substr(text, 1, 5000) AS stored,
    CASE WHEN length(source || '@' || lang || '.example') > 20 THEN substr(source || '@' || lang || '.example', 1, 18) || '…' ELSE source || '@' || lang || '.example' END AS mail FROM documents"""
)
def shortened_texts(spark, sf_dir):
    """The title before a slash, line breaks, texts cut for reading and for storing, short addresses."""
    mail = F.concat("source", F.lit("@"), "lang", F.lit(".example"))
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    return docs.select("doc_id", text.title_head("text").alias("head"), text.line_breaks(text.cut("text", "reading")).alias("read"), text.cut("text", "stored").alias("stored"), text.short_mail(mail).alias("mail"))


@query("SELECT n_regionkey, string_agg(n_name || ':' || n_nationkey, ';' ORDER BY n_nationkey) AS kept FROM nation GROUP BY n_regionkey")
def projected_arrays(spark, sf_dir):
    """Arrays of structs with two of their three fields."""
    held = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", "n_regionkey"))).alias("a"))
    slim = held.select("n_regionkey", values.projected(F.col("a"), "n_name", "n_nationkey").alias("a"))
    return slim.select("n_regionkey", F.array_join(F.transform("a", lambda x: F.concat(x["n_name"], F.lit(":"), x["n_nationkey"].cast("string"))), ";").alias("kept"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'DE: gut, FR: ' || c_name WHEN 1 THEN 'DE: gut' ELSE 'FR: ' || c_name END AS languages FROM customer")
def merged_maps(spark, sf_dir):
    """The right map wins; a null map is empty."""
    k = F.col("c_custkey") % 3
    left = F.when(k == 0, F.create_map(F.lit("de"), F.lit("gut"), F.lit("fr"), F.lit("wenig"))).when(k == 1, F.create_map(F.lit("de"), F.lit("gut")))
    right = F.when(k != 1, F.create_map(F.lit("fr"), F.col("c_name")))
    return _customers(spark, sf_dir, "c_custkey", "c_name").select("c_custkey", values.map_text(values.merged(left, right)).alias("languages"))


@query(
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || ', ' || c_mktsegment WHEN 1 THEN c_name WHEN 2 THEN c_mktsegment ELSE '' END AS place,
    CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN CASE WHEN c_nationkey > 1 THEN 'CV + ' || c_nationkey || ' Arbeitszeugnisse werden beim Matching berücksichtigt' WHEN c_nationkey = 1 THEN 'CV + 1 Arbeitszeugnis werden beim Matching berücksichtigt' ELSE 'CV wird berücksichtigt' END
      ELSE 'CV & Arbeitszeugnisse hochladen' END AS documents,
    CASE WHEN c_custkey % 4 = 0 THEN 'Melde dich an, um das KI-Matching zu nutzen.' WHEN c_custkey % 4 = 1 THEN '' WHEN c_custkey % 4 = 2 THEN 'Profil erstellen für genauere Matches.' ELSE 'Erstelle ein Profil und markiere Organisationen mit ⭐ für bessere Ergebnisse.' END AS hint
    FROM customer"""
)
def places_and_hints(spark, sf_dir):
    k = F.col("c_custkey") % 4
    city, canton = F.when(k < 2, F.col("c_name")).otherwise(""), F.when(k % 2 == 0, F.col("c_mktsegment"))
    rows = _customers(spark, sf_dir, "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    return rows.select("c_custkey", labels.place(city, canton).alias("place"), labels.document_hint(k != 0, k == 1, F.col("c_nationkey")).alias("documents"), labels.profile_hint(k != 0, k == 1, k == 2).alias("hint"))


@query(
    """SELECT event_id, CASE event_type WHEN 'signup' THEN 'CV' WHEN 'view' THEN 'Zeugnis' ELSE 'Dokument' END AS label, CASE event_type WHEN 'signup' THEN '📄' WHEN 'view' THEN '📜' ELSE '📎' END AS icon,
    CASE event_type WHEN 'signup' THEN 'CV' WHEN 'view' THEN 'Arbeitszeugnis' ELSE 'Dokument' END AS saved,
    CASE WHEN event_type = 'view' THEN 'A &amp; B' || CASE WHEN user_id % 2 = 0 THEN ' · ' || user_id ELSE '' END ELSE '' END AS source, CASE event_id % 3 WHEN 0 THEN 'natur=Natur' WHEN 1 THEN 'bau=Bau' END AS option FROM events"""
)
def labels_by_kind(spark, sf_dir):
    """Signups stand for CVs, views for certificates."""
    kind = F.when(F.col("event_type") == "signup", "cv").when(F.col("event_type") == "view", "zeugnis").otherwise("andere")
    chosen = labels.options({"natur": "Natur", "bau": "Bau"}, (F.col("event_id") % 3).cast("int"))
    shown = labels.certificate_source(kind, F.lit("A & B"), F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events", ["event_id", "user_id", "event_type"]).select(
        "event_id", labels.document_label(kind).alias("label"), labels.document_icon(kind).alias("icon"), labels.saved_label(kind).alias("saved"), shown.alias("source"),
        F.concat(chosen["key"], F.lit("="), chosen["label"]).alias("option"),
    )


@query("""SELECT CAST(user_id AS VARCHAR) AS user_id, '{"kind":"' || event_type || '","user":' || user_id || '}' AS search_params, CAST(user_id % 7 AS INTEGER) AS results_count, TIMESTAMP '2024-02-01' AS created_at FROM events""")
def log_rows(spark, sf_dir):
    events = table(spark, sf_dir, "events", ["user_id", "event_type"]).withColumn("who", F.col("user_id").cast("string"))
    return sinks.log_rows(events, "who", {"kind": F.col("event_type"), "user": F.col("user_id")}, F.col("user_id") % 7, F.lit("2024-02-01").cast("timestamp_ntz"))


LETTER_SQL = """WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE role = 'assistant'),
  c AS (SELECT conv_id, count(*) AS n, string_agg('Arbeitgeber: Firma ' || turn || CASE WHEN turn % 4 = 1 THEN chr(10) || 'Zitate: sehr gut / gern' ELSE '' END || CASE WHEN text <> '' THEN chr(10) || 'Inhalt: ' || substr(text, 1, 1500) ELSE '' END, chr(10) || '---' || chr(10) ORDER BY turn) AS z FROM t WHERE i <= 3 GROUP BY conv_id),
  u AS (SELECT conv_id, coalesce(max(text) FILTER (WHERE turn = 0), '') AS cv FROM conversations GROUP BY conv_id)
SELECT u.conv_id, 'LEBENSLAUF:' || chr(10) || substr(cv, 1, 4000) || CASE WHEN n > 0 THEN chr(10) || chr(10) || 'ARBEITSZEUGNISSE:' || chr(10) || z ELSE '' END
  || chr(10) || chr(10) || 'STELLE:' || chr(10) || 'Titel: Stelle ' || u.conv_id || chr(10) || 'Organisation: Org' || chr(10) || 'Ort: ' || CASE WHEN u.conv_id % 2 = 0 THEN 'Bern' ELSE 'nicht angegeben' END
  || chr(10) || 'Pensum: nicht angegeben' || chr(10) || 'Warum passend: ' || chr(10) || 'Stärken-Match: a, b' AS request,
  CASE WHEN u.conv_id % 3 = 0 THEN 'Lettre' ELSE 'Brief' END AS opening FROM u LEFT JOIN c ON u.conv_id = c.conv_id"""


@query(LETTER_SQL)
def letter_request(spark, sf_dir):
    """The first turn stands for the CV, assistants' turns for certificates; only three of these are gathered."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    some = sync.first_k(turns.filter("role = 'assistant'"), ["conv_id"], ["turn"], 3)
    quotes = F.when(F.col("turn") % 4 == 1, F.array(F.lit("sehr gut"), F.lit("gern")))
    certificate = F.struct("turn", F.concat(F.lit("Firma "), F.col("turn").cast("string")).alias("employer"), F.lit("").alias("period"), quotes.alias("notable_quotes"), "text")
    held = some.groupBy("conv_id").agg(F.array_sort(F.collect_list(certificate)).alias("certificates"))
    cv = turns.groupBy("conv_id").agg(F.coalesce(F.max(F.when(F.col("turn") == 0, F.col("text"))), F.lit("")).alias("cv"))
    k = F.col("conv_id")
    job = F.struct(
        F.concat(F.lit("Stelle "), k.cast("string")).alias("title"), F.lit("Org").alias("organization"), F.when(k % 2 == 0, "Bern").otherwise("").alias("location"),
        F.lit(None).cast("string").alias("pensum"), F.lit("").alias("reason"), F.array(F.lit("a"), F.lit("b")).alias("highlights"),
    )
    none = F.slice(F.array(F.struct(F.lit(0).cast("long").alias("turn"), F.lit("").alias("employer"), F.lit("").alias("period"), F.array(F.lit("")).alias("notable_quotes"), F.lit("").alias("text"))), 1, 0)
    rows = cv.join(held, "conv_id", "left").select("conv_id", "cv", F.coalesce("certificates", none).alias("certificates"), job.alias("job"))
    language = F.when(k % 3 == 0, "fr").when(k % 3 == 1, "de")
    return rows.select("conv_id", documents.letter_request(F.col("cv"), F.col("certificates"), "job").alias("request"), documents.by_language(language, F.lit("Brief"), F.lit("Lettre")).alias("opening"))


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 10 > 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 10 > 0")
def emptied_sets(spark, sf_dir):
    """Every tenth user sends an empty set, and so has none."""
    orders = table(spark, sf_dir, "orders", ["o_custkey", "o_orderkey", "o_orderstatus"])
    part = lambda s: orders.filter(F.col("o_orderstatus") == s).select("o_custkey", "o_orderkey")
    emptied = orders.select("o_custkey").filter("o_custkey % 10 = 0")
    return sync.replace_set(part("F"), part("P").filter("o_custkey % 10 > 0"), "o_custkey", emptied)


@query(
    """SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.v ELSE o.v END AS v, o.created FROM (SELECT c_custkey AS id, -1 AS v, c_name AS created FROM customer WHERE c_custkey % 2 = 0) o
    FULL JOIN (SELECT user_id AS id, arg_max(event_id, (ts, event_id)) AS v FROM events GROUP BY user_id) n ON o.id = n.id"""
)
def upsert_last_write(spark, sf_dir):
    """Many writes to one key: the last replaces the stored row, whose other columns stay."""
    old = _customers(spark, sf_dir, "c_custkey", "c_name").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.lit(-1).cast("long").alias("v"), F.col("c_name").alias("created"))
    new = table(spark, sf_dir, "events", ["user_id", "event_id", "ts"]).select(F.col("user_id").alias("id"), F.col("event_id").alias("v"), "ts")
    return sync.upsert(old, new, "id", ["ts", "v"])
