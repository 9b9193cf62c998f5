"""Queries over events as a user's state: toggles, upserts, caches, limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmark.operators import limits, store, sync
from strandmark.plans.registry import query
from strandmark.sources import sinks
from strandmark.sources.folders import fresh_folder
from strandmark.sources.tables import table
from strandmark.streaming import timed


@query(
    """WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN 'alle' ELSE event_type END AS item FROM events),
    c AS (SELECT user_id, max((ts, event_id)) AS cleared FROM e WHERE item = 'alle' GROUP BY user_id)
    SELECT e.user_id, item FROM e LEFT JOIN c ON e.user_id = c.user_id WHERE item <> 'alle' AND (cleared IS NULL OR (ts, event_id) > cleared) GROUP BY e.user_id, item HAVING count(*) % 2 = 1"""
)
def toggle_state(spark, sf_dir):
    clicks = table(spark, sf_dir, "events", ["user_id", "event_id", "ts", "event_type"]).withColumn("item", F.when(F.col("event_type") == "error", "alle").otherwise(F.col("event_type")))
    return sync.toggle_state(clicks, "user_id", "item", ["ts", "event_id"])


@query(
    "SELECT user_id, event_type, event_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1"
)
def upsert_latest(spark, sf_dir):
    return sync.latest(table(spark, sf_dir, "events", ["user_id", "event_type", "event_id", "ts", "value"]), ["user_id", "event_type"], ["ts", "event_id"])


@query(
    """SELECT coalesce(n.k, o.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.v ELSE o.v END AS v, o.extra FROM (SELECT c_custkey AS k, c_acctbal AS v, c_name AS extra FROM customer WHERE c_custkey % 2 = 0) o
    FULL JOIN (SELECT c_custkey AS k, -c_acctbal AS v FROM customer WHERE c_custkey % 3 = 0) n ON o.k = n.k"""
)
def upsert_columns(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_name").alias("extra"))
    return sync.upsert(customers.filter("k % 2 = 0"), customers.filter("k % 3 = 0").select("k", (-F.col("v")).alias("v")), "k")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P'")
def replace_set(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", ["o_custkey", "o_orderkey", "o_orderstatus"])
    part = lambda s: orders.filter(F.col("o_orderstatus") == s).select("o_custkey", "o_orderkey")
    return sync.replace_set(part("F"), part("P"), "o_custkey")


def _store(spark, rows, key, buckets=16):
    """A keyed store that has these rows."""
    held = store.KeyedStore(spark, fresh_folder(spark, "store"), [key], buckets)
    held.change(rows, lambda _, new: new)
    return held


@query(
    """SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.v ELSE o.v END AS v, o.name FROM (SELECT c_custkey AS id, c_acctbal AS v, c_name AS name FROM customer) o
    FULL JOIN (SELECT o_custkey * 2 AS id, max_by(o_totalprice, (o_orderdate, o_orderkey)) AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey) n ON o.id = n.id"""
)
def store_upsert(spark, sf_dir):
    """Customers in a keyed store; the last of several orders replaces a value, or is a row of its own."""
    held = _store(spark, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), F.col("c_name").alias("name")), "id")
    sent = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select((F.col("o_custkey") * 2).alias("id"), F.col("o_totalprice").alias("v"), "o_orderdate", "o_orderkey")
    held.upsert(sent, ["o_orderdate", "o_orderkey"], "orders", 1)
    held.upsert(sent.withColumn("v", -F.col("v")), ["o_orderdate", "o_orderkey"], "orders", 1)  # a batch that was there
    return held.read()


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def store_delete(spark, sf_dir):
    held = _store(spark, table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"]), "o_custkey")
    held.delete(table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")))
    return held.read()


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 7 > 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 7 > 0")
def store_replace_set(spark, sf_dir):
    """Customers who sent a new set have just that one; every seventh sent an empty one."""
    orders = table(spark, sf_dir, "orders", ["o_custkey", "o_orderkey", "o_orderstatus"])
    part = lambda s: orders.filter(F.col("o_orderstatus") == s).select("o_custkey", "o_orderkey")
    held = _store(spark, part("F"), "o_custkey")
    held.replace_sets(part("P").filter("o_custkey % 7 > 0"), senders=orders.filter("o_custkey % 7 = 0"))
    return held.read()


_KV = "(SELECT user_id AS k, arg_max(event_type, (ts, event_id)) AS last, arg_max(event_id, (ts, event_id)) AS v FROM events GROUP BY user_id)"


@query(f"SELECT k, v FROM {_KV} WHERE last <> 'error' UNION ALL SELECT c_custkey, -1 FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)")
def removed_values(spark, sf_dir):
    """Stored values of customers, then a log of writes in which errors remove; read before and after the log is merged in, which is the same."""
    stored = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(-1).cast("long").alias("v"))
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), F.col("event_id").alias("v"), "ts", (F.col("event_type") == "error").alias("gone"))
    held = _store(spark, stored, "k")
    before = sync.with_log(held.read(), log, ["k"], ["ts", "v"], "gone")
    first = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    held.apply_log(log.filter(first), ["ts", "v"], "gone", "log", 1)
    held.apply_log(log.filter(~first), ["ts", "v"], "gone", "log", 2)
    after = held.read()
    return before.withColumn("side", F.lit(1)).unionByName(after.withColumn("side", F.lit(2))).groupBy("k", "v").agg(F.count_distinct("side").alias("n")).select("k", F.when(F.col("n") == 2, F.col("v")).alias("v"))


@query("SELECT event_id, user_id FROM events WHERE user_id <> 3")
def delete_by_key(spark, sf_dir):
    return sync.delete_by_key(table(spark, sf_dir, "events", ["event_id", "user_id"]), "user_id", 3)


@query(
    """SELECT id, updated_at, education, n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, r DESC) AS i FROM (
    SELECT user_id AS id, max(ts) AS updated_at, 'local' AS education, count(*) AS n, 0 AS r FROM events WHERE event_type = 'click' GROUP BY user_id UNION ALL
    SELECT user_id, max(ts), CASE WHEN user_id % 4 = 0 THEN '' ELSE 'remote' END, count(*), 1 FROM events WHERE event_type = 'view' GROUP BY user_id) WHERE education <> '') WHERE i = 1"""
)
def newer_profile(spark, sf_dir):
    """Clicks and views stand for the edits of two devices; every fourth remote profile has no data."""
    events = table(spark, sf_dir, "events", ["user_id", "ts", "event_type"])

    def side(kind, education):
        rows = events.filter(F.col("event_type") == kind).groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("updated_at"), F.count("*").alias("n"))
        return rows.select("id", "updated_at", education.alias("education"), F.lit("").alias("field_of_study"), F.lit(None).cast("string").alias("experience"), "n")

    local, remote = side("click", F.lit("local")), side("view", F.when(F.col("id") % 4 == 0, "").otherwise("remote"))
    return sync.newer_profile(local, remote).select("id", "updated_at", "education", "n")


@query(
    """SELECT user_id, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1 AND ts + INTERVAL 24 HOURS >= TIMESTAMP '2024-01-30 12:00:00'"""
)
def ttl_cache_valid(spark, sf_dir):
    now = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    return limits.valid_entries(table(spark, sf_dir, "events", ["user_id", "ts", "event_id"]), "user_id", "ts", now)


@query("SELECT event_id FROM events WHERE TIMESTAMP '2024-01-20 00:00:00' - ts <= INTERVAL 24 HOURS")
def fresh_results(spark, sf_dir):
    now = F.lit("2024-01-20").cast("timestamp_ntz")
    return table(spark, sf_dir, "events", ["event_id", "ts"]).filter(limits.fresh(F.col("ts"), now)).select("event_id")


RATE_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s(user_id, i, event_id, kept, accepted) AS (
  SELECT user_id, i, event_id, [t], true FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.i, e.event_id,
    CASE WHEN len(list_filter(s.kept, lambda x: x >= e.t - 86400000000)) < 5 THEN list_append(list_filter(s.kept, lambda x: x >= e.t - 86400000000), e.t) ELSE list_filter(s.kept, lambda x: x >= e.t - 86400000000) END,
    len(list_filter(s.kept, lambda x: x >= e.t - 86400000000)) < 5
  FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT event_id, user_id, accepted FROM s"""


@query(RATE_SQL)
def rate_limit(spark, sf_dir):
    """Five accepted requests a day and user."""
    return limits.rate_limited(table(spark, sf_dir, "events", ["event_id", "user_id", "ts"]), "user_id", "ts", "event_id", 5, 86_400).select("event_id", "user_id", "accepted")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS load FROM events")
def offered_load(spark, sf_dir):
    return limits.offered_load(table(spark, sf_dir, "events", ["event_id", "user_id", "ts"]), "user_id", "ts", "1 DAY").select("event_id", "load")


@query("SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NULL OR nxt - ts > INTERVAL 6 HOURS")
def debounce(spark, sf_dir):
    return limits.debounced(table(spark, sf_dir, "events", ["event_id", "user_id", "ts"]), "user_id", "ts", "event_id", "6 HOURS").select("event_id", "user_id")


QUOTA_SQL = """WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'cv' WHEN 'view' THEN 'zeugnis' ELSE 'andere' END AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
s(user_id, i, event_id, cv, z, r, outcome) AS (
  SELECT user_id, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), 0, 0, 0, '' FROM e WHERE i = 1
  UNION ALL
  SELECT e.user_id, e.i, e.event_id,
    CASE WHEN s.cv + s.z + s.r < 6 AND e.k = 'cv' THEN 1 ELSE s.cv END,
    CASE WHEN s.cv + s.z + s.r < 6 AND e.k = 'zeugnis' AND s.z < 5 THEN s.z + 1 ELSE s.z END,
    CASE WHEN s.cv + s.z + s.r < 6 AND e.k = 'andere' THEN s.r + 1 ELSE s.r END,
    CASE WHEN s.cv + s.z + s.r >= 6 OR (e.k = 'zeugnis' AND s.z >= 5) THEN 'rejected' WHEN e.k = 'cv' AND s.cv > 0 THEN 'replaced' ELSE 'stored' END
  FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT event_id, outcome FROM s WHERE i > 0"""


@query(QUOTA_SQL)
def document_quota(spark, sf_dir):
    """Signups stand for CVs, views for certificates."""
    kind = F.when(F.col("event_type") == "signup", "cv").when(F.col("event_type") == "view", "zeugnis").otherwise("andere")
    uploads = table(spark, sf_dir, "events", ["event_id", "user_id", "event_type"]).select("event_id", "user_id", kind.alias("doc_type"))
    return limits.document_quota(uploads, "user_id", ["event_id"], fresh_folder(spark, "uploads")).select("event_id", "outcome")


def _arriving(spark, sf_dir, start):
    """Runs a stream over events that arrive in three deliveries; each run goes on from the state of the one before."""
    folder, events = fresh_folder(spark, "arriving"), table(spark, sf_dir, "events", ["event_id", "user_id", "ts", "event_type"])
    store_path, checkpoint = fresh_folder(spark, "store"), fresh_folder(spark, "checkpoint")
    days = [None, "2024-01-11", "2024-01-21", None]
    for low, high in zip(days, days[1:]):
        inside = (F.lit(True) if low is None else F.col("ts") >= F.lit(low).cast("timestamp_ntz")) & (F.lit(True) if high is None else F.col("ts") < F.lit(high).cast("timestamp_ntz"))
        sinks.append(events.filter(inside), folder)
        start(spark.readStream.schema(events.schema).parquet(folder), store_path, checkpoint).awaitTermination()
    return store.KeyedStore(spark, store_path, ["key"]).read()


_WATERMARK = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 10 MINUTES FROM events)"


@query(f"SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM events) WHERE i = 1 AND ts + INTERVAL 24 HOURS >= {_WATERMARK}")
def ttl_cache_stream(spark, sf_dir):
    """The cache of ``ttl_cache_valid`` kept by a stream whose state expires; the watermark is the time."""
    start = lambda stream, path, checkpoint: timed.expiring_cache(stream, "user_id", "ts", "event_id", F.col("event_id"), 24, "10 minutes", path, checkpoint)
    return _arriving(spark, sf_dir, start).select(F.col("key").alias("user_id"), F.col("payload").cast("long").alias("event_id"))


@query(
    f"""SELECT user_id, unnest(CASE WHEN event_type = 'error' THEN [] ELSE [event_type, 'i' || event_id % 20] END) AS item FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
    WHERE (nxt IS NULL OR nxt - ts > INTERVAL 6 HOURS) AND ts + INTERVAL 6 HOURS < {_WATERMARK}) WHERE i = 1"""
)
def debounced_sets_stream(spark, sf_dir):
    """``debounce``, then ``replace_set``, by a stream with timers; errors send an empty set."""
    items = F.when(F.col("event_type") == "error", F.array().cast("array<string>")).otherwise(F.array("event_type", F.concat(F.lit("i"), (F.col("event_id") % 20).cast("string"))))
    start = lambda stream, path, checkpoint: timed.sets_after_silence(stream, "user_id", "ts", "event_id", items, 21_600, "10 minutes", path, checkpoint)
    return _arriving(spark, sf_dir, start).select(F.col("key").alias("user_id"), "item")
