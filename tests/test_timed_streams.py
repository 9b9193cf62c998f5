"""Streams with timers against the batch operators, with late, equal and repeated times."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strandmark.operators import limits, sync
from strandmark.operators.store import KeyedStore
from strandmark.streaming import timed

T0 = datetime(2024, 1, 1)
SCHEMA = "user string, ts timestamp, id long, items array<string>"


def batches(spark, folder, parts):
    """A stream that gives one part after the other."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(folder / f"{i:02d}"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def events(seed, n=160, minutes=30):
    """Times in order, but for some that are up to ``late`` behind; equal times; a few users."""
    rnd, at, out = random.Random(seed), T0, []
    for i in range(n):
        at += timedelta(minutes=rnd.choice([0, 0, 1, 4, 9, 10, 11, minutes]))
        back = timedelta(minutes=rnd.choice([0, 0, 0, 8]))
        out.append((rnd.choice("abcd"), at - back, i, rnd.sample(["x", "y", "z"], rnd.randrange(4))))
    return out


def watermark(query):
    """Of the last micro-batch."""
    at = [p["eventTime"]["watermark"] for p in query.recentProgress if "watermark" in p["eventTime"]]
    return datetime.fromisoformat(at[-1].removesuffix("Z"))


@pytest.mark.parametrize("seed", [1, 2])
def test_expiring_cache(spark, tmp_path, seed):
    data = events(seed, minutes=200)
    stream = batches(spark, tmp_path / "in", [data[i : i + 40] for i in range(0, len(data), 40)])
    query = timed.expiring_cache(stream, "user", "ts", "id", F.col("id"), 1, "10 minutes", str(tmp_path / "store"), str(tmp_path / "c"), 2)
    query.awaitTermination(180)
    now = watermark(query)
    assert now == max(e[1] for e in data) - timedelta(minutes=10)
    last = {}
    for user, at, i, _ in data:
        last[user] = max(last.get(user, (at, i)), (at, i))
    want = {(u, i) for u, (at, i) in last.items() if at + timedelta(hours=1) >= now}
    got = KeyedStore(spark, str(tmp_path / "store"), ["key"]).read()
    assert {(r["key"], int(r["payload"])) for r in got.collect()} == want
    held = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress]
    assert max(held) > min(held[held.index(max(held)) :])  # state ends with what it stands for


@pytest.mark.parametrize("seed", [3, 4])
def test_sets_after_silence(spark, tmp_path, seed):
    data = events(seed)
    stream = batches(spark, tmp_path / "in", [data[i : i + 40] for i in range(0, len(data), 40)])
    query = timed.sets_after_silence(stream, "user", "ts", "id", F.col("items"), 600, "10 minutes", str(tmp_path / "store"), str(tmp_path / "c"), 2)
    query.awaitTermination(180)
    now = watermark(query)
    kept = limits.debounced(spark.createDataFrame(data, SCHEMA), "user", "ts", "id", "10 MINUTES").filter(F.col("ts") + F.expr("INTERVAL 10 MINUTES") < F.lit(now))
    last = sync.latest(kept, ["user"], ["ts", "id"])
    want = {(r["user"], r["item"]) for r in last.select("user", F.explode("items").alias("item")).collect()}
    got = {(r["key"], r["item"]) for r in KeyedStore(spark, str(tmp_path / "store"), ["key"]).read().collect()}
    assert got == want and kept.count() > 8


def test_everything_that_was_silent_is_handed_on(spark, tmp_path):
    data = events(5)
    stream = batches(spark, tmp_path / "in", [data[i : i + 50] for i in range(0, len(data), 50)])
    with timed.settings(spark, timed.STATE_STORE | {"spark.sql.shuffle.partitions": "2"}):
        query = timed.silenced(stream, "user", "ts", "id", F.lit("p"), 600, "10 minutes").writeStream.format("memory").queryName("silenced").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(180)
    now = watermark(query)
    kept = limits.debounced(spark.createDataFrame(data, SCHEMA), "user", "ts", "id", "10 MINUTES").filter(F.col("ts") + F.expr("INTERVAL 10 MINUTES") < F.lit(now))
    assert sorted(r["tie"] for r in spark.table("silenced").collect()) == sorted(r["id"] for r in kept.collect())


def test_sets_run_the_stream_once_a_batch(spark, tmp_path):
    """What a batch's jobs share is computed once, and sessions are Spark's own."""
    stream = batches(spark, tmp_path / "in", [events(6, 20)])
    plan = timed.silenced(stream, "user", "ts", "id", F.lit("p"), 600, "10 minutes")._jdf.queryExecution().analyzed().toString()
    assert "session_window" in plan and "TransformWithState" not in plan
    runs = spark.sparkContext.accumulator(0)

    def seen(rows):
        for frame in rows:
            runs.add(len(frame))
            yield frame

    with timed.held(spark.range(10).mapInPandas(seen, "id long")) as kept:
        assert kept.count() == kept.distinct().count() == 10
    assert runs.value == 10


def test_state_of_many_keys_is_few_values(spark, tmp_path):
    data = [(f"u{i}", T0 + timedelta(seconds=i % 50), i, []) for i in range(600)]
    query = timed.expiring_cache(batches(spark, tmp_path / "in", [data]), "user", "ts", "id", F.col("id"), 1, "10 minutes", str(tmp_path / "store"), str(tmp_path / "c"), 2, buckets=4)
    query.awaitTermination(180)
    assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) <= 4
    assert KeyedStore(spark, str(tmp_path / "store"), ["key"]).read().count() == 600
