"""The stateful operators on streams (extensions of the batch forms in operators.limits)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmark.operators.store import KeyedStore


def rate_limited(events: DataFrame, user: str, time: str, tie: str, most: int, seconds: int) -> DataFrame:
    """Decisions for a stream of requests; the state of a user is the last ``most`` accepted times.

    Within a micro-batch requests are decided in order of time; one that arrives in a later batch is decided then.
    """

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state):
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(frames).sort_values(["at", "tie"])
        accepted = []
        for at in rows["at"]:
            ok = at == at and at is not None and (len(kept) < most or kept[0] < at - seconds * 1_000_000)  # a null time is rejected
            if ok:
                kept = [*kept, at][-most:]
            accepted.append(ok)
        state.update((kept,))
        yield pd.DataFrame({"user": key[0], "tie": rows["tie"], "accepted": accepted})

    requests = events.select(F.col(user).cast("string").alias("user"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(tie).cast("long").alias("tie"))
    return requests.groupBy("user").applyInPandasWithState(decide, "user string, tie long, accepted boolean", "kept array<long>", "append", "NoTimeout")


def keep_latest(stream: DataFrame, keys: list[str], order: list[str], path: str, checkpoint: str, buckets: int = 64):
    """Starts a query that keeps the last row of each key in a keyed store; a micro-batch rewrites the buckets of its keys alone, and one
    that comes again after a failure changes nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        KeyedStore(batch.sparkSession, path, keys, buckets).keep_latest(batch, order, writer=checkpoint, batch=number)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge).trigger(availableNow=True).start()


def debounced(events: DataFrame, key: str, time: str, gap: str) -> DataFrame:
    """The last event of each burst: bursts are session windows, closed by ``gap`` without an event."""
    watched = events.withWatermark(time, gap)
    return watched.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.max(time).alias(time), F.count("*").alias("n")).select(key, time, "n")
