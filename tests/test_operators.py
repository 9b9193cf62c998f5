"""Operators on small tables: joins, sync, policies, limits, sources, sinks and streams."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strandmark.operators import counts, joins, limits, policy, search, sync
from strandmark.operators.store import KeyedStore
from strandmark.sources import sinks, tables
from strandmark.streaming import state

T0 = datetime(2024, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def profiles(spark, data):
    return spark.createDataFrame([(k, t, e, None, "", r) for k, t, e, r in data], "id string, updated_at timestamp, education string, field_of_study string, experience string, desired_regions array<string>")


def test_newer_profile(spark):
    later = T0 + timedelta(1)
    local = profiles(spark, [("a", T0, "L", []), ("b", later, "L", []), ("c", T0, "L", []), ("d", later, "", ["x"]), ("e", T0, "", [])])
    remote = profiles(spark, [("a", T0, "R", []), ("b", T0, "R", []), ("d", T0, "R", []), ("e", None, "R", [])])
    got = {r["id"]: r["education"] for r in sync.newer_profile(local, remote).collect()}
    assert got == {"a": "R", "b": "L", "c": "L", "d": "R"}
    row = sync.profile_row(local.withColumns({"workload_min": F.lit(0), "workload_max": F.lit(None).cast("int"), "languages": F.lit(None).cast("map<string,string>")}), F.lit(later)).first()
    assert (row["languages"], row["updated_at"]) == ({}, T0)
    assert (row["workload_min"], row["workload_max"], row["experience"]) == (50, 100, None)
    assert local.select(sync.is_filled(F.col("education"), F.col("field_of_study"), F.col("experience"), F.col("desired_regions"))).filter("NOT (1=0)").collect()[3][0] is True


def test_reset(spark):
    df = spark.createDataFrame([("a", "x", 70), ("b", "y", 80)], "id string, education string, workload_min int")
    assert rows(sync.reset(df, df.filter("id = 'a'"))) == [("a", None, 50), ("b", "y", 80)]


def test_merged_sets(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), (None, ["x"])], "l array<string>, r array<string>")
    m = sync.merged_set(F.col("l"), F.col("r"))
    assert [tuple(r) for r in df.select(m, sync.to_insert(m, F.col("r"))).collect()] == [(["a", "b", "c"], ["a"]), (["x"], [])]


def test_upsert_and_replace(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, v string, extra string")
    new = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert rows(sync.upsert(old, new, "k")) == [(1, "a", "x"), (2, None, "y"), (3, "c", None)]
    assert rows(sync.replace_set(old.select("k", "v"), new, "k")) == [(1, "a"), (2, None), (3, "c")]
    assert rows(sync.delete_by_key(old, "k", 1).select("k")) == [(2,)]
    assert rows(sync.bulk_rows(spark.createDataFrame([("u", ["a", "b"])], "user string, favs array<string>"), "user", "favs", "org")) == [("u", "a"), ("u", "b")]


def test_upsert_with_maps(spark):
    old = spark.createDataFrame([(1, {"de": "gut"}, "x")], "id int, languages map<string,string>, extra string")
    new = spark.createDataFrame([(1, {"fr": "a"}), (1, {"fr": "b"}), (2, None)], "id int, languages map<string,string>")
    got = {r["id"]: (r["languages"], r["extra"]) for r in sync.upsert(old, new, "id").collect()}
    assert got == {1: ({"fr": "b"}, "x"), 2: (None, None)}
    nested = spark.createDataFrame([(1, [({"a": 1},)])], "id int, n array<struct<m:map<string,int>>>")
    assert sync.upsert(nested, nested, "id").count() == 1


def test_several_writes_and_empty_sets(spark):
    old = spark.createDataFrame([(1, "a", "x")], "k int, v string, extra string")
    new = spark.createDataFrame([(1, "b", 1), (1, "c", 3), (2, "d", 2), (2, "e", 1)], "k int, v string, at int")
    assert rows(sync.upsert(old, new, "k", ["at"])) == [(1, "c", "x"), (2, "d", None)]
    assert rows(sync.upsert(old, new.drop("at"), "k")) == [(1, "c", "x"), (2, "e", None)]
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    assert rows(sync.replace_set(stored, stored.filter("k = 1"), "k", stored.filter("k = 2"))) == [(1, "a"), (3, "c")]


def test_many_locations(spark):
    places = [(1, "Bern"), (2, "Zug"), (3, None), (4, ""), (5, "Bern"), (6, "Zürich Zürich"), (7, "𝄞Ort")]
    orgs = spark.createDataFrame(places, "id int, loc string").withColumns({"a.b": F.lit(1), "_id": F.lit(b"x")})
    for names in (["er", "x", None], ["", "q"], ["Bernau"], ["Zug", "ug", "Bern"], [], [None], ["ürich Z", "ü"], ["𝄞Or"], ["𝄞O", "Bern", "Berne", "Z"]):
        picked = spark.createDataFrame([(n,) for n in names], "name string")
        want = [(i,) for i, place in places if place is not None and any(n is not None and n in place for n in names)]
        assert rows(search.near_locations(orgs, picked).select("id")) == want


def test_joins(spark):
    orgs = spark.createDataFrame([(1, "Bern"), (2, "Zug"), (3, None)], "id int, loc string")
    favs = spark.createDataFrame([(1,), (9,), (1,)], "org int")
    assert rows(joins.among(orgs, favs, "id", "org").select("id")) == [(1,)]
    assert rows(joins.flagged(orgs, favs, "id", "org").select("id", "is_fav")) == [(1, True), (2, False), (3, False)]
    assert rows(joins.missing(orgs.select("id"), favs.toDF("id"), ["id"])) == [(2,), (3,)]
    assert rows(search.near_locations(orgs, spark.createDataFrame([("er",)], "name string")).select("id")) == [(1,)]
    assert rows(joins.set_null(favs.toDF("fk"), orgs, "fk", "id")) == [(1,), (1,), (None,)]
    assert rows(joins.cascade(favs.toDF("fk"), orgs, "fk", "id")) == [(1,), (1,)]
    assert orgs.select(joins.looked_up(F.col("loc"), {"Bern": "BE"})).collect()[0][0] == "BE"
    cache = spark.createDataFrame([(1, T0), (2, T0 - timedelta(seconds=1))], "id int, expires timestamp")
    assert rows(joins.valid_cache(orgs, cache, "id", "expires", F.lit(T0)).filter("expires is not null").select("id")) == [(1,)]


def test_counts(spark):
    orgs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, cat string")
    assert tuple(counts.totals(orgs, "cat", orgs.filter("false")).first()) == (3, 2, "—")
    df = spark.createDataFrame([("x",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(counts.letter_count(F.col("t"))).collect()] == [1, 0, 0]


def test_policies(spark):
    df = spark.createDataFrame([("a", True), ("b", False), (None, False), (None, True), ("b", None)], "submitted_by string, approved boolean")
    assert policy.visible(df, "community_orgs", "b").count() == 4
    assert policy.visible(df, "community_orgs", None).count() == 2
    logs = spark.createDataFrame([("a",), (None,)], "user_id string")
    assert policy.visible(logs, "search_logs", "a").count() == 0 and policy.visible(logs, "search_logs", "b", "insert").count() == 1
    assert policy.visible(logs, "favorites", "a", "update").count() == 0 and policy.visible(logs, "cv_uploads", "a", "delete").count() == 1


def simulate(events, most, seconds):
    kept, out = {}, {}
    for user, at, number in sorted(events, key=lambda e: (e[1], e[2])):
        held = kept.setdefault(user, [])
        out[number] = sum(t >= at - timedelta(seconds=seconds) for t in held) < most
        if out[number]:
            held.append(at)
    return out


def test_rate_limit(spark):
    rnd = random.Random(2)
    events = [(rnd.choice("abc"), T0 + timedelta(seconds=rnd.randrange(400)), i) for i in range(300)]
    events += [("d", T0 + timedelta(seconds=s), 1000 + s) for s in (0, 1, 2, 3, 4, 60, 61, 62)]
    df = spark.createDataFrame(events, "user string, ts timestamp, id int")
    got = {r["id"]: r["accepted"] for r in limits.rate_limited(df, "user", "ts", "id", 5, 60).collect()}
    assert got == simulate(events, 5, 60)
    assert got[1060] is False and got[1061] is True  # the bound is inclusive
    assert limits.rate_limited(df.filter("false"), "user", "ts", "id", 5, 60).collect() == []


def test_runs_between_gaps(spark):
    rnd = random.Random(4)
    events, at = [], T0
    for i in range(3000):  # one user, bursts between pauses of all lengths around the interval
        at += timedelta(seconds=rnd.choice([0, 0, 1, 5, 20, 59, 60, 61, 90]))
        events.append(("hot", at, i))
    events += [(None, T0, 5000), (None, T0, 5001), ("b", None, 5002), ("hot", None, 5003)]
    df = spark.createDataFrame(events, "user string, ts timestamp, id int").repartition(7)
    limited = limits.rate_limited(df, "user", "ts", "id", 3, 60)
    assert limited.columns == ["user", "ts", "id", "accepted"]
    got = {r["id"]: r["accepted"] for r in limited.collect()}
    assert got == simulate([e for e in events if e[1]], 3, 60) | {5002: False, 5003: False}
    runs = limits.quiet_runs(df.withColumn("t", F.unix_micros("ts")), "user", "t", 60_000_000)
    assert runs.filter("user = 'hot' and t is not null").select("_run").distinct().count() > 300


def quota(uploads, total=6, certificates=5):
    """user, order, kind: the fold itself."""
    held, out = {}, {}
    for user, at, kind in sorted(uploads, key=lambda u: (str(u[0]), u[1])):
        docs = held.setdefault(user, [])
        if len(docs) >= total or kind == "zeugnis" and docs.count("zeugnis") >= certificates:
            out[at] = "rejected"
        elif kind == "cv" and "cv" in docs:
            out[at] = "replaced"
        else:
            docs.append(kind)
            out[at] = "stored"
    return out


def test_document_quota(spark, tmp_path):
    kinds = ["cv", "zeugnis", "cv", "zeugnis", "zeugnis", "zeugnis", "zeugnis", "zeugnis", "cv"]
    df = spark.createDataFrame([("u", i, k) for i, k in enumerate(kinds)], "user string, n int, doc_type string")
    got = [r["outcome"] for r in limits.document_quota(df, "user", ["n"], str(tmp_path / "q1")).orderBy("n").collect()]
    assert got == ["stored", "stored", "replaced", "stored", "stored", "stored", "stored", "rejected", "rejected"]
    assert limits.document_quota(df.filter("false"), "user", ["n"], str(tmp_path / "q2")).collect() == []


@pytest.mark.parametrize("weights", [(1, 1, 1), (3, 9, 0), (1, 60, 0), (0, 1, 0), (5, 0, 0)])
def test_a_user_in_many_parts(spark, tmp_path, monkeypatch, weights):
    rnd = random.Random(sum(weights))
    uploads = [(rnd.choice(["hot"] * 9 + ["a", "b", None]), i, rnd.choices(["cv", "zeugnis", rnd.choice(["andere", None])], weights)[0]) for i in range(2500)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        found = limits.document_quota(spark.createDataFrame(uploads, "user string, n int, doc_type string"), "user", ["n"], str(tmp_path / "q"))
        assert {r["n"]: r["outcome"] for r in found.collect()} == quota(uploads)
        parts = spark.read.parquet(str(tmp_path / "q")).filter("_at >= 0 and user = 'hot'").select("_part").distinct().count()
        assert parts > 8
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_toggle_twice(spark):
    df = spark.createDataFrame([("u", 1, "a"), ("u", 2, "a"), ("u", 3, "b"), ("u", 4, "alle"), ("u", 5, "c")], "user string, n int, item string")
    assert rows(sync.toggle_state(df, "user", "item", ["n"])) == [("u", "c")]


def test_candidates(spark):
    fav = spark.createDataFrame([(3, 2), (1, 0)], "id int, pos int")
    near = spark.createDataFrame([(i, i) for i in range(15)], "id int, pos int")
    got = [r["id"] for r in search.candidates(fav, near, "id", "pos").collect()]
    assert got == [1, 3, 0, 2, 4, 5, 6, 7, 8, 9]


def test_order(spark):
    df = spark.createDataFrame([("Basel",), ("Ägeri",), ("Aarau",)], "n string")
    assert [r[0] for r in search.german_order(df, "n").collect()] == ["Aarau", "Ägeri", "Basel"]


def test_rank_of_a_whole_table(spark, tmp_path):
    rnd = random.Random(7)
    data = [(i, rnd.choice(["a", "B", "ä", None, "zz", "Z"]), rnd.random()) for i in range(500)]
    df = spark.createDataFrame(data, "id int, t string, x double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = search.ranked(df, [F.lower("t"), -F.col("x"), "id"], str(tmp_path / "r"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = sorted(data, key=lambda r: (r[1] is not None, (r[1] or "").lower(), -r[2], r[0]))
    assert [tuple(r) for r in placed.orderBy("place").drop("place").collect()] == want
    assert [r["place"] for r in placed.orderBy("place").collect()] == list(range(1, 501)) and placed.columns == ["id", "t", "x", "place"]
    assert len(list((tmp_path / "r").glob("part-*"))) > 2
    assert search.ranked(df.filter("false"), ["id"], str(tmp_path / "e")).collect() == []


def test_sources_and_sinks(spark, tmp_path):
    nested = tables.literal(spark, [{"key": "k1", "orgs": [("a", "Bern"), ("b", "")]}, {"key": "k2", "orgs": []}], "key string, orgs array<struct<id:string,loc:string>>")
    assert rows(tables.flattened(nested)) == [("k1", 0, 0, "a", "Bern"), ("k1", 0, 1, "b", "")]
    (tmp_path / "a.pdf").write_bytes(b"BT (Hi) Tj ET")
    (tmp_path / "big.pdf").write_bytes(b"x" * 100)
    (tmp_path / "c.txt").write_bytes(b"no")
    assert tables.pdf_files(spark, str(tmp_path), 50).count() == 1
    with pytest.raises(ValueError):
        tables.single(spark.createDataFrame([(1,), (1,)], "k int"), "k", 1)
    pages = spark.createDataFrame([("", None, 200, "x"), ("u", None, 404, "x"), ("u", "timeout", None, None), ("u", None, 200, "<p>x</p>")], "url string, error string, status int, html string")
    assert [r["content"] for r in tables.live_pages(pages).collect()] == [None, None, tables.NOT_LOADED, "x"]
    out = str(tmp_path / "t")
    sinks.append(pages, out), sinks.append(pages, out)
    assert spark.read.parquet(out).count() == 8
    sinks.overwrite(pages, out)
    assert spark.read.parquet(out).count() == 4
    log = sinks.log_rows(pages.limit(1), "url", {"org_count": F.lit(12)}, F.lit(3), F.lit(T0)).first()
    assert log["search_params"] == '{"org_count":12}' and log["results_count"] == 3
    letters = sinks.letters_as_html(spark.createDataFrame([("a\nb",)], "t string"), "t", F.lit("fr"), F.lit("A & B"))
    assert letters.first()["html"] == '<!DOCTYPE html>\n<html lang="fr">\n<head>\n<meta charset="utf-8">\n<title>Bewerbung – A &amp; B</title>\n</head>\n<body>\na<br>\nb\n</body>\n</html>'
    sinks.export_text(letters, "html", str(tmp_path / "letters"))
    assert sinks.stored_values(letters, "t", F.struct("t")).first()["value"] == '{"t":"a\\nb"}'


def test_streams(spark, tmp_path):
    events = [("a", T0 + timedelta(seconds=s), s) for s in range(8)]
    df = spark.createDataFrame(events, "user string, ts timestamp, id long")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = state.rate_limited(stream, "user", "ts", "id", 5, 60).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r["tie"]: r["accepted"] for r in spark.table("limited").collect()} == simulate(events, 5, 60)
    state.keep_latest(stream, ["user"], ["ts"], str(tmp_path / "latest"), str(tmp_path / "c2")).awaitTermination(120)
    assert rows(KeyedStore(spark, str(tmp_path / "latest"), ["user"]).read().select("user", "id")) == [("a", 7)]
