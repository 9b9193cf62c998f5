"""Queries over the directory: search with facets, favourites, candidates, counts, visibility, references."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmark.functions import labels, text
from strandmark.operators import counts, joins, limits, policy, search, sync
from strandmark.plans.registry import query
from strandmark.sources.folders import fresh_folder
from strandmark.sources.tables import table

CARDS = "SELECT c_custkey, c_name, c_nationkey, c_mktsegment, n_name, lower(c_name || ' ' || n_name || ' ' || c_mktsegment) AS search_text FROM customer JOIN nation ON c_nationkey = n_nationkey"
HITS = f"SELECT * FROM ({CARDS}) WHERE contains(search_text, 'customer') AND contains(search_text, '1') AND contains(n_name, '_1') AND c_mktsegment IN ('BUILDING', 'MACHINERY')"


def _cards(spark, sf_dir):
    """Customers as cards; nations, a table of fixed size, are left to the optimiser to broadcast."""
    nations = table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    joined = table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]).join(nations, F.col("c_nationkey") == F.col("n_nationkey")).drop("n_nationkey")
    return joined.withColumn("search_text", text.search_text("c_name", "n_name", "c_mktsegment"))


def _hits(spark, sf_dir):
    return search.search(_cards(spark, sf_dir), "1 Customer", ["_1"], ["BUILDING", "MACHINERY"], text="search_text", location="n_name", category="c_mktsegment")


@query(HITS)
def search_with_facets(spark, sf_dir):
    return _hits(spark, sf_dir)


@query(f"SELECT DISTINCT c_mktsegment FROM ({HITS})")
def visible_sections(spark, sf_dir):
    sections = table(spark, sf_dir, "customer", ["c_mktsegment"]).distinct()
    return search.visible_sections(sections, _hits(spark, sf_dir), "c_mktsegment")


@query(
    """SELECT n_name, n, CASE WHEN n >= 12 THEN n || ' Unternehmen' WHEN n >= 5 THEN n || ' Orgs' ELSE CAST(n AS VARCHAR) END AS label
    FROM (SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)"""
)
def location_counts(spark, sf_dir):
    by_key = counts.count_by(table(spark, sf_dir, "supplier", ["s_nationkey"]), "s_nationkey").withColumnRenamed("s_nationkey", "n_nationkey")
    slots = table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    return joins.slot_counts(by_key, slots, "n_nationkey").join(slots, "n_nationkey").select("n_name", "n", labels.count_label(F.col("n")).alias("label"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def category_counts(spark, sf_dir):
    return counts.count_by(table(spark, sf_dir, "customer", ["c_mktsegment"]), "c_mktsegment")


@query("SELECT (SELECT count(*) FROM customer) AS orgs, (SELECT count(DISTINCT c_mktsegment) FROM customer) AS categories, CASE WHEN count(*) = 0 THEN '—' ELSE CAST(count(*) AS VARCHAR) END AS favourites FROM events WHERE event_type = 'purchase'")
def totals(spark, sf_dir):
    marked = table(spark, sf_dir, "events", ["event_type"]).filter("event_type = 'purchase'")
    return counts.totals(table(spark, sf_dir, "customer", ["c_mktsegment"]), "c_mktsegment", marked)


def _favourites(spark, sf_dir):
    return table(spark, sf_dir, "events", ["user_id", "event_type"]).filter("event_type = 'purchase'").select("user_id")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def favourite_semi_join(spark, sf_dir):
    return joins.among(table(spark, sf_dir, "customer", ["c_custkey", "c_name"]), _favourites(spark, sf_dir), "c_custkey", "user_id")


@query("SELECT c_custkey, c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase') AS is_fav FROM customer")
def favourite_flags(spark, sf_dir):
    return joins.flagged(table(spark, sf_dir, "customer", ["c_custkey"]), _favourites(spark, sf_dir), "c_custkey", "user_id")


@query(
    """SELECT s_nationkey, s_suppkey, src_rank FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY src_rank, s_suppkey) AS i FROM (
    SELECT s_nationkey, s_suppkey, min(r) AS src_rank FROM (SELECT s_nationkey, s_suppkey, 0 AS r FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT s_nationkey, s_suppkey, 1 FROM supplier WHERE s_suppkey % 3 = 0) GROUP BY ALL)) WHERE i <= 10"""
)
def candidate_union(spark, sf_dir):
    """Well-funded suppliers stand for favourites, every third for those nearby, nations for users."""
    suppliers = table(spark, sf_dir, "supplier", ["s_nationkey", "s_suppkey", "s_acctbal"])
    chosen = lambda condition: suppliers.filter(condition).select("s_nationkey", "s_suppkey", F.col("s_suppkey").alias("pos"))
    return search.candidates(chosen("s_acctbal > 5000"), chosen("s_suppkey % 3 = 0"), "s_suppkey", "pos", "s_nationkey").select("s_nationkey", "s_suppkey", "src_rank")


@query("SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal > 0 UNION SELECT s_nationkey FROM supplier")
def location_union(spark, sf_dir):
    """Distinct values over two sources."""
    return table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_nationkey").union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


#: Umlauts stand with their base letters; if nothing else differs, behind them.
TOWNS = ["Zürich", "Agau", "Ägau", "Uster", "Üster", "Olten", "Ölten", "Basel", "Ägeri", "Aarau", "Zug"]
_TOWN = f"[{', '.join(f"'{t}'" for t in TOWNS)}][1 + c_custkey % {len(TOWNS)}] || ' ' || n_name"


@query(f"SELECT c_custkey, town, row_number() OVER (ORDER BY translate(lower(town), 'äöü', 'aou'), town, c_custkey) AS place FROM (SELECT c_custkey, {_TOWN} AS town FROM customer JOIN nation ON c_nationkey = n_nationkey)")
def german_rank(spark, sf_dir):
    """The German order itself is compared, as the place of each row in the whole table."""
    nations = table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    rows = table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"]).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    town = F.concat(F.get(F.array(*map(F.lit, TOWNS)), F.col("c_custkey") % len(TOWNS)), F.lit(" "), "n_name")
    placed = search.ranked(rows.select("c_custkey", town.alias("town")), [search.german("town"), "c_custkey"], fresh_folder(spark, "ranked"))
    return placed.select("c_custkey", "town", "place")


@query("SELECT event_id, ts FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id DESC")
def newest_first(spark, sf_dir):
    return search.newest_first(table(spark, sf_dir, "events", ["event_id", "ts", "event_type"]).filter("event_type = 'signup'").drop("event_type"), "ts", "event_id")


@query("SELECT p_partkey, p_name, p_size FROM part ORDER BY p_size DESC, p_name, p_partkey LIMIT 10")
def topk_score(spark, sf_dir):
    return search.top_scores(table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_size"]), "p_size", "p_name", "p_partkey")


@query("SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS n_user, count(*) FILTER (WHERE role = 'assistant') AS n_assistant FROM conversations GROUP BY conv_id")
def doc_type_counts(spark, sf_dir):
    return counts.kinds(table(spark, sf_dir, "conversations", ["conv_id", "role"]), ["conv_id"], "role", ["user", "assistant"])


@query("SELECT conv_id, string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn) AS joined FROM conversations GROUP BY conv_id")
def joined_text(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    return turns.groupBy("conv_id").agg(counts.joined_text(F.col("text"), ["turn"], "\n---\n").alias("joined"))


@query("SELECT count(*) AS n FROM events WHERE user_id = 7 AND ts >= TIMESTAMP '2024-01-10 00:00:00'")
def request_count(spark, sf_dir):
    recent = (F.col("user_id") == 7) & limits.in_last(F.col("ts"), F.lit("2024-01-30").cast("timestamp_ntz"), "20 DAYS")
    return counts.count_where(table(spark, sf_dir, "events", ["user_id", "ts"]), recent)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def referential_cascade(spark, sf_dir):
    alive = table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"]).filter("c_acctbal > 0")
    return joins.cascade(table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"]), alive, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN o_custkey END AS o_custkey FROM orders")
def referential_set_null(spark, sf_dir):
    alive = table(spark, sf_dir, "customer", ["c_custkey", "c_acctbal"]).filter("c_acctbal > 0")
    return joins.set_null(table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"]), alive, "o_custkey", "c_custkey")


@query("SELECT doc_id, quality FROM labels WHERE quality = 1 OR doc_id % 10 = 4")
def row_policy(spark, sf_dir):
    """Good documents are approved; the last digit of the id stands for the submitter, some have none."""
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", (F.col("quality") == 1).alias("approved"), F.when(F.col("doc_id") % 10 != 0, (F.col("doc_id") % 10).cast("string")).alias("submitted_by"))
    return policy.visible(rows, "community_orgs", "4").select("doc_id", "quality")


@query("SELECT c_custkey AS id, c_name AS email, 50 AS workload_min, 100 AS workload_max FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def derived_profiles(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("email"))
    return joins.derived_profiles(users, table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("id"))).select("id", "email", "workload_min", "workload_max")


@query("SELECT s_suppkey, s_name, n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey >= 2) ON s_nationkey = n_nationkey")
def cache_lookup(spark, sf_dir):
    """Nations stand for cache rows, regions for their expiry."""
    cache = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
    suppliers = table(spark, sf_dir, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    return joins.valid_cache(suppliers, cache, "s_nationkey", "n_regionkey", F.lit(2)).select("s_suppkey", "s_name", "n_name")


@query(
    """SELECT user_id, array_to_string(list_sort(list_distinct(local)) || list_filter(list_sort(list_distinct(remote)), lambda x: NOT list_contains(local, x)), ',') AS merged,
    array_to_string(list_filter(list_sort(list_distinct(local)), lambda x: NOT list_contains(remote, x)), ',') AS missing
    FROM (SELECT user_id, coalesce(list(CAST(event_id % 20 AS VARCHAR)) FILTER (WHERE event_type = 'click'), []) AS local, coalesce(list(CAST(event_id % 20 AS VARCHAR)) FILTER (WHERE event_type = 'view'), []) AS remote FROM events GROUP BY user_id)"""
)
def favourite_merge(spark, sf_dir):
    """Clicks stand for the local set, views for the remote one; sets have at most 20 members."""
    item = (F.col("event_id") % 20).cast("string")
    members = lambda kind: F.array_sort(F.collect_set(F.when(F.col("event_type") == kind, item)))
    sets = table(spark, sf_dir, "events", ["user_id", "event_id", "event_type"]).groupBy("user_id").agg(members("click").alias("l"), members("view").alias("r"))
    merged = sync.merged_set(F.col("l"), F.col("r"))
    return sets.select("user_id", F.array_join(F.concat(F.array_sort(F.array_intersect(merged, "l")), F.array_sort(F.array_except(merged, "l"))), ",").alias("merged"), F.array_join(F.array_sort(sync.to_insert(merged, F.col("r"))), ",").alias("missing"))
