"""The keyed store: what a change writes, and what it leaves alone."""

import random

import pytest
from pyspark.sql import functions as F

from strandmark.operators.store import Conflict, KeyedStore


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in (path / "data").rglob("*.parquet")}


@pytest.fixture
def store(spark, tmp_path):
    held = KeyedStore(spark, str(tmp_path / "s"), ["k"], buckets=8)
    held.upsert(spark.createDataFrame([(i, f"v{i}") for i in range(200)], "k int, v string"))
    return held


def test_only_touched_buckets_are_written(spark, store, tmp_path):
    before, folders = files(tmp_path / "s"), store.version()["folders"]
    assert len(folders) == 8
    store.upsert(spark.createDataFrame([(7, "new")], "k int, v string"))
    after = store.version()["folders"]
    assert sum(after[b] != folders[b] for b in folders) == 1
    now = files(tmp_path / "s")
    assert all(now[f] == t for f, t in before.items()) and {f.split("/")[2] for f in now.keys() - before.keys()} == {f"bucket={b}" for b in folders if after[b] != folders[b]}
    assert rows(store.read().filter("k = 7")) == [(7, "new")] and store.read().count() == 200
    assert rows(store.read(1).filter("k = 7")) == [(7, "v7")]  # the older version is as it was
    assert rows(store.of_keys(spark.createDataFrame([(7,), (8,), (999,)], "k int"))) == [(7, "new"), (8, "v8")]
    store.vacuum()
    assert store.versions() == [2] and store.read().count() == 200 and len(files(tmp_path / "s")) < len(now)


def test_a_batch_that_comes_again(spark, store):
    batch = spark.createDataFrame([(1, "x"), (500, "y")], "k int, v string")
    assert store.upsert(batch, writer="w", batch=3) is True
    state, seen = store.version(), rows(store.read())
    assert store.upsert(batch.withColumn("v", F.lit("z")), writer="w", batch=3) is False and store.delete(batch, writer="w", batch=2) is False
    assert store.version() == state and rows(store.read()) == seen
    assert store.delete(batch, writer="w", batch=4) is True and store.read().count() == 199
    assert store.delete(batch, writer="other", batch=0) is True


def test_a_change_that_dies_or_loses(spark, store, tmp_path, monkeypatch):
    seen = rows(store.read())

    def dies(stored, new):
        return stored.select("k", F.raise_error(F.lit("lost")).cast("string").alias("v"))

    with pytest.raises(Exception, match="lost"):
        store.change(spark.createDataFrame([(1, "x")], "k int, v string"), dies)
    assert rows(store.read()) == seen
    stale = store.version()
    store.upsert(spark.createDataFrame([(1, "x")], "k int, v string"))
    monkeypatch.setattr(store, "version", lambda number=None: stale)
    with pytest.raises(Conflict):
        store.upsert(spark.createDataFrame([(1, "late")], "k int, v string"))
    monkeypatch.undo()
    assert rows(store.read().filter("k = 1")) == [(1, "x")]
    with pytest.raises(ValueError, match="null"):
        store.upsert(spark.createDataFrame([(None, "x")], "k int, v string"))


def test_random_changes(spark, tmp_path):
    rnd, model = random.Random(5), {}
    store = KeyedStore(spark, str(tmp_path / "s"), ["k"], buckets=3)
    with pytest.raises(ValueError):
        store.read()
    for step in range(8):
        sent = [(rnd.randrange(20), rnd.randrange(100), step * 10 + i, rnd.random() < 0.4) for i in range(rnd.randrange(1, 6))]
        df = spark.createDataFrame(sent, "k int, v int, at int, gone boolean")
        if step % 3 == 2:
            store.apply_log(df, ["at"], "gone")
            for k, v, at, gone in sent:
                model.pop(k, None)
                if not gone:
                    model[k] = [(k, v, at)]
        elif step % 3 == 1:
            store.replace_sets(df.select("k", "v", "at"))
            for k in {s[0] for s in sent}:
                model[k] = [s[:3] for s in sent if s[0] == k]
        else:
            store.keep_latest(df.select("k", "v", "at"), ["at"])
            for k, v, at, _ in sent:
                model[k] = [max([*model.get(k, []), (k, v, at)], key=lambda r: r[2])]
        assert rows(store.read()) == sorted((r for held in model.values() for r in held), key=str)
    store.delete(store.read())
    assert store.read().collect() == [] and store.version()["folders"] == {}


def test_a_hot_key(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), ["user", "kind"], buckets=4)
    store.replace_sets(spark.range(5000).select(F.lit("hot").alias("user"), F.lit("a").alias("kind"), "id"))
    store.replace_sets(spark.createDataFrame([("hot", "b", 1)], "user string, kind string, id long"))
    assert store.read().groupBy("kind").count().orderBy("kind").collect() == [("a", 5000), ("b", 1)]
