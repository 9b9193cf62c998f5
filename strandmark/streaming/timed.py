"""Streams whose state ends by itself: a cache that expires, and sets that are handed on after silence."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from strandmark.operators.store import KeyedStore
from strandmark.operators.sync import latest

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """These settings while a stream starts, which keeps them; the session gets its own back."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def held(batch: DataFrame):
    """The rows of a micro-batch, so that what a store does with them, in several jobs, doesn't run the stream's operators again."""
    kept = batch.persist()
    try:
        yield kept
    finally:
        kept.unpersist()


def _rows(events: DataFrame, key: str, time: str, tie: str, payload: Column, late: str) -> DataFrame:
    """key, at (microseconds), tie and payload (text); the watermark trails the last time by ``late``."""
    read = events.withColumn(time, F.col(time).cast("timestamp")).filter(F.col(time).isNotNull() & F.col(key).isNotNull()).withWatermark(time, late)
    return read.select(F.col(key).alias("key"), F.col(time).alias("time"), F.unix_micros(time).alias("at"), F.col(tie).cast("long").alias("tie"), payload.cast("string").alias("payload"))


class Expiring(StatefulProcessor):
    """The last write of each key of a bucket, until it is older than ``ttl`` microseconds by the watermark; then it leaves the state.

    The state of a bucket is chunks of keys, times and ties: a micro-batch adds one with what it changed, and timers, for the first of a chunk
    to expire, put the chunks together. So calls from Python to the state are as many as the buckets, whatever the number of keys.
    """

    #: Chunks of a bucket that are put together without a timer.
    MOST = 16

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", StructType([StructField("number", LongType())]), StructType([StructField("rows", BinaryType())]))

    def due(self, at):
        """The first millisecond at which a write of that time has expired; just at its end it is valid."""
        return (at + self.ttl) // 1000 + 1

    @staticmethod
    def last(rows: pd.DataFrame) -> pd.DataFrame:
        """The last write of each key; of equal ones the first that is there."""
        return rows.iloc[::-1].sort_values(["at", "tie"], kind="stable").drop_duplicates("key", keep="last")

    def read(self) -> tuple[pd.DataFrame | None, int]:
        """The last write of each key, and the number of chunks."""
        held = [pa.ipc.open_stream(rows).read_pandas() for (rows,) in self.chunks.values()]
        return self.last(pd.concat(held)) if held else None, len(held)

    def add(self, rows: pd.DataFrame, number: int) -> None:
        table, out = pa.Table.from_pandas(rows[["key", "at", "tie"]], preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(out, table.schema) as stream:
            stream.write_table(table)
        self.chunks.updateValue((number,), (out.getvalue().to_pybytes(),))
        self.handle.registerTimer(int(self.due(rows["at"].min())))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, number = self.read()
        if last is not None:
            last = last.assign(payload=None, new=False)
        for frame in rows:
            sent = frame[["key", "at", "tie", "payload"]].assign(new=True)
            last = self.last(sent if last is None else pd.concat([last, sent]))
        written = last[last["new"]]
        if number >= self.MOST:
            self.chunks.clear()
            self.add(last, 0)
        elif len(written):
            self.add(written, number)
        if len(written):
            yield written[["key", "at", "tie", "payload"]].assign(gone=False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, _ = self.read()
        if held is None:
            return
        over = self.due(held["at"]) <= expiredTimerInfo.getExpiryTimeInMs()
        over |= self.due(held["at"]) <= timerValues.getCurrentWatermarkInMs()
        self.chunks.clear()
        if not over.all():
            self.add(held[~over], 0)
        if over.any():
            yield held[over][["key", "at", "tie"]].assign(payload=None, gone=True)

    def close(self) -> None:
        pass


def expiring_cache(events: DataFrame, key: str, time: str, tie: str, payload: Column, hours: int, late: str, path: str, checkpoint: str, partitions: int = 24, buckets: int = 1024) -> StreamingQuery:
    """Starts a stream that keeps, in a keyed store at ``path``, the last write of each key that hasn't expired by the watermark.

    The store's rows (key, at, tie, payload) are those of ``limits.valid_entries`` with the watermark as now. A key's state is its time and tie, among
    those of one of ``buckets`` hashes of keys, and is removed with the row. Rows later than ``late`` are dropped by the watermark; rows without key or time don't count.
    """
    spark = events.sparkSession
    rows = _rows(events, key, time, tie, payload, late)
    kind = dict(rows.dtypes)["key"]
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))
    changes = dealt.groupBy("bucket").transformWithStateInPandas(Expiring(hours * 3_600_000_000), f"key {kind}, at long, tie long, payload string, gone boolean", "Append", "EventTime")

    def apply(batch: DataFrame, number: int) -> None:
        # a key may expire and be written again in one batch: its write, if there is one, is later
        with held(batch.withColumn("order", ~F.col("gone"))) as log:
            KeyedStore(spark, path, ["key"]).apply_log(log, ["at", "tie", "order"], "gone", checkpoint, number)

    with settings(spark, STATE_STORE | {"spark.sql.shuffle.partitions": str(partitions)}):
        return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply).trigger(availableNow=True).start()


def silenced(events: DataFrame, key: str, time: str, tie: str, payload: Column, seconds: int, late: str) -> DataFrame:
    """key, at, tie, payload of the events that ``limits.debounced`` keeps, each once its silence is over by the watermark.

    They are the last ones of sessions, which Spark keeps as one row each and ends by the watermark; events exactly ``seconds`` apart
    belong together, so a session ends a microsecond later. A late event counts for as long as its own silence isn't over.
    """
    rows = _rows(events, key, time, tie, payload, late)
    session = F.session_window("time", f"{seconds * 1_000_000 + 1} microseconds")
    last = rows.groupBy(session, "key").agg(F.max(F.struct("at", "tie", "payload")).alias("last"))
    return last.select("key", "last.*")


def sets_after_silence(events: DataFrame, key: str, time: str, tie: str, items: Column, seconds: int, late: str, path: str, checkpoint: str, partitions: int = 24) -> StreamingQuery:
    """Starts a stream that replaces, in a keyed store at ``path``, each key's set (key, item) by the last one that was followed by silence.

    ``items`` is an array of texts; an empty one empties the set. Only the sets of a micro-batch that are the last of their key are written.
    """
    spark = events.sparkSession
    sent = silenced(events, key, time, tie, F.to_json(items), seconds, late)

    def apply(batch: DataFrame, number: int) -> None:
        with held(latest(batch, ["key"], ["at", "tie"])) as last:
            rows = last.select("key", F.explode(F.from_json("payload", "array<string>")).alias("item"))
            KeyedStore(spark, path, ["key"]).replace_sets(rows, checkpoint, number, senders=last)

    with settings(spark, STATE_STORE | {"spark.sql.shuffle.partitions": str(partitions)}):
        return sent.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply).trigger(availableNow=True).start()
