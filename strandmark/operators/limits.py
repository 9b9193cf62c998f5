"""Caches, rate limits, debounce and quotas: operations that depend on time and on earlier decisions."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_last(time: Column, now: Column, interval: str) -> Column:
    """Not older than the interval, the bound included."""
    return time >= now - F.expr(f"INTERVAL {interval}")


def fresh(time: Column, now: Column, interval: str = "24 HOURS") -> Column:
    """Results of exactly that age are still shown."""
    return now - time <= F.expr(f"INTERVAL {interval}")


def valid_entries(writes: DataFrame, key: str, time: str, now: Column, interval: str = "24 HOURS") -> DataFrame:
    """The latest write of each key, if it hasn't expired."""
    others = [c for c in writes.columns if c not in (key, time)]
    last = writes.groupBy(key).agg(F.max(F.struct(time, *others)).alias("_r"))
    flat = last.select(key, f"_r.{time}", *(F.col(f"_r.{c}").alias(c) for c in others))
    return flat.filter(F.col(time) + F.expr(f"INTERVAL {interval}") >= now)


def offered_load(events: DataFrame, user: str, time: str, interval: str) -> DataFrame:
    """Events of the user in the trailing interval; an upper bound of what a limiter counts, not its count."""
    load = F.expr(f"count(*) OVER (PARTITION BY `{user}` ORDER BY `{time}` RANGE BETWEEN INTERVAL {interval} PRECEDING AND CURRENT ROW)")
    return events.withColumn("load", load)


def debounced(events: DataFrame, key: str, time: str, tie: str, interval: str) -> DataFrame:
    """Events that are followed by silence of more than the interval."""
    after = F.lead(time).over(Window.partitionBy(key).orderBy(time, tie))
    return events.withColumn("_next", after).filter(F.col("_next").isNull() | (F.col("_next") - F.col(time) > F.expr(f"INTERVAL {interval}"))).drop("_next")


def quiet_runs(events: DataFrame, user: str, at: str, width: int) -> DataFrame:
    """Adds ``_run``: a user's events fall into runs, between which lie more than ``width`` without an event.

    Such a gap is longer than a bucket of ``width``, so the first and last event of each bucket show all gaps; only these, a row a bucket that
    isn't empty, are ordered by user. Rows without a time have no run.
    """
    rows = events.withColumn("_bucket", F.floor(F.col(at) / width))
    ends = rows.filter(F.col(at).isNotNull()).groupBy(user, "_bucket").agg(F.min(at).alias("_first"), F.max(at).alias("_last"))
    order = Window.partitionBy(user).orderBy("_bucket")
    before = F.lag("_last").over(order)
    begins = ends.withColumn("_begins", (before.isNull() | (F.col("_first") - before > width)).cast("int"))
    runs = begins.select(F.col(user).alias("_user"), F.col("_bucket").alias("_b"), F.sum("_begins").over(order).alias("_run"))
    return rows.join(runs, rows[user].eqNullSafe(F.col("_user")) & (rows["_bucket"] == F.col("_b")), "left").drop("_user", "_b", "_bucket")


def rate_limited(events: DataFrame, user: str, time: str, tie: str, most: int, seconds: int) -> DataFrame:
    """Adds ``accepted``: whether fewer than ``most`` accepted requests of the user lie in the closed interval before.

    Only accepted requests count, so each decision depends on those before it, but for a gap longer than the interval: nothing before it
    counts after it. So the runs between a user's gaps are dealt, not users, and sorted by time in Spark; a task streams through its
    runs and holds just the last ``most`` accepted times of one. Only requests that never pause for the interval stay together. A null
    user is a user, a null time is rejected and doesn't count.
    """
    width = seconds * 1_000_000
    timed = events.withColumn("_t", F.unix_micros(F.col(time).cast("timestamp")))
    dealt = quiet_runs(timed, user, "_t", width).repartition(F.col(user), F.col("_run")).sortWithinPartitions(user, "_run", time, tie)
    helpers = {"_t", "_run"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kept = object(), deque(maxlen=most)
        for batch in batches:
            names = batch.schema.names
            accepted = []
            for *key, at in zip(*(batch.column(names.index(n)).to_pylist() for n in (user, "_run", "_t"))):
                if key != current:
                    current = key
                    kept.clear()
                ok = at is not None and (len(kept) < most or kept[0] < at - width)
                if ok:
                    kept.append(at)
                accepted.append(ok)
            columns = [c for n, c in zip(names, batch.columns) if n not in helpers]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(accepted, pa.bool_())], [*(n for n in names if n not in helpers), "accepted"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    return dealt.mapInArrow(run, f"{fields}, accepted boolean")


class Quota:
    """The rule of ``document_quota`` as tables: what an upload does in each state, and the state after it."""

    OUTCOMES = ["stored", "replaced", "rejected"]

    def __init__(self, total: int, certificates: int):
        states = [(cv, z, r) for cv in (0, 1) for z in range(certificates + 1) for r in range(total + 1) if cv + z + r <= total]
        number = {s: i for i, s in enumerate(states)}
        self.states, self.empty = len(states), number[0, 0, 0]
        self.next = np.tile(np.arange(self.states), (3, 1))  # by kind: CV, certificate, other
        self.outcome = np.full((3, self.states), 2)
        for kind in range(3):
            for i, (cv, z, r) in enumerate(states):
                if cv + z + r >= total or kind == 1 and z >= certificates:
                    continue
                self.outcome[kind, i] = kind == 0 and cv
                self.next[kind, i] = number[max(cv, kind == 0), z + (kind == 1), r + (kind == 2)]


def document_quota(uploads: DataFrame, user: str, order: list[str], path: str, kind: str = "doc_type", total: int = 6, certificates: int = 5) -> DataFrame:
    """Adds ``outcome`` of each upload: stored, replaced (an earlier CV), or rejected.

    A user with ``total`` documents can't add any; one with ``certificates`` of them no further certificate; a CV replaces the one there is. A
    null user is a user, a null kind is another document.

    Each decision depends on those before it, but what a user has is one of a few states. Uploads are ranged by user and order, so that a user
    with many of them lies in many parts, and the parts are written to ``path``, with the map from any state to the state after it for
    the uploads with which a part begins, as they may go on from the part before. These maps, one a part, are composed part after part; then every
    part knows its first state and decides its uploads by itself.
    """
    rule, names = Quota(total, certificates), uploads.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in uploads.schema)
    code = F.when(F.col(kind) == "cv", 0).when(F.col(kind) == "zeugnis", 1).otherwise(2)
    ranged = uploads.withColumn("_code", code).repartitionByRange(user, *order).sortWithinPartitions(user, *order)

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows with part and position, then one that has the part's first user and map, and one with its last user and state."""
        part, at, current, first, after, state = TaskContext.get().partitionId(), 0, None, True, np.arange(rule.states), rule.empty
        heads: list[pa.RecordBatch] = []
        for batch in batches:
            n, users = batch.num_rows, batch.column(batch.schema.get_field_index(user))
            for who, what in zip(users.to_pylist(), batch.column(n_columns).to_pylist()):
                if heads and who != current:
                    first, state = False, rule.empty
                if not heads:
                    heads.append(batch.slice(0, 1))
                current = who
                if first:
                    after = rule.next[what][after]
                else:
                    state = rule.next[what, state]
            last = batch.slice(n - 1, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * n, pa.int32()), pa.array(range(at, at + n), pa.int64()), pa.nulls(n, pa.list_(pa.int32()))], columns)
            at += n
        if heads:
            for row, mark, found in ((heads[0], -1, after.tolist()), (last, -2, [-1 if first else int(state)])):
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([part], pa.int32()), pa.array([mark], pa.int64()), pa.array([found], pa.list_(pa.int32()))], columns)

    n_columns, columns = len(names), [*names, "_code", "_part", "_at", "_map"]
    ranged.mapInArrow(mapped, f"{fields}, _code int, _part int, _at long, _map array<int>").write.parquet(path)
    rows = uploads.sparkSession.read.parquet(path)

    # the first user of a part, its map; the last user of a part, the state after it: two rows a part
    starts, before, state = {}, None, rule.empty
    for r in rows.filter("_at < 0").select("_part", "_at", F.struct(user).alias("u"), "_map").orderBy("_part", F.desc("_at")).collect():
        if r["_at"] == -1:
            starts[r["_part"]] = state if before is not None and before == r["u"] else rule.empty
            after = r["_map"][starts[r["_part"]]]
        else:
            before, state = r["u"], after if r["_map"][0] < 0 else r["_map"][0]
    outcome, following = rule.outcome.tolist(), rule.next.tolist()

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, current, state = None, None, rule.empty
        for batch in batches:
            found = []
            for part, who, what in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("_part", user, "_code"))):
                if part != here:
                    here, current, state = part, who, starts[part]
                elif who != current:
                    current, state = who, rule.empty
                found.append(Quota.OUTCOMES[outcome[what][state]])
                state = following[what][state]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(found, pa.string())], [*names, "outcome"])

    return rows.filter("_at >= 0").repartition("_part").sortWithinPartitions("_part", "_at").mapInArrow(decided, f"{fields}, outcome string")
