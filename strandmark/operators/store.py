"""A table by key that is changed in place: only the buckets of changed keys are written anew, and a version makes them count."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandmark.operators import sync
from strandmark.sources.folders import Files

Merge = Callable[[DataFrame, DataFrame], DataFrame]


class Conflict(RuntimeError):
    """Another writer published a version first."""


class KeyedStore:
    """Rows dealt into ``buckets`` by the hash of their keys.

    ``path`` holds ``data/<change>/bucket=<b>``, what a change wrote for each bucket that it touched, and ``versions/<n>.json``, which names the
    folder of every bucket. A change writes its folder first and its version last, under the next number and in one step, so readers see
    all of it or nothing, and a change that dies leaves only files that no version names. Two writers of one version: the second is refused.
    A version also has the number of each writer's last batch; a batch that comes again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets
        self.files = Files(spark, self.path)

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names(f"{self.path}/versions") if n.endswith(".json"))

    def version(self, number: int | None = None) -> dict:
        """The last version, or an older one that is kept; an empty one before the first change."""
        if number is None:
            number = max(self.versions(), default=0)
        return json.loads(self.files.read(f"{self.path}/versions/{number:09d}.json")) if number else {"number": 0, "schema": None, "folders": {}, "writers": {}}

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, version: dict, buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(version["schema"])
        paths = [f"{self.path}/data/{folder}/bucket={b}" for b, folder in version["folders"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, number: int | None = None) -> DataFrame:
        """The rows as the last version has them, or an older one."""
        version = self.version(number)
        if version["schema"] is None:
            raise ValueError(f"nothing was written to {self.path}")
        return self._read(version)

    def of_keys(self, wanted: DataFrame) -> DataFrame:
        """The rows of some keys; only their buckets are read."""
        version = self.version()
        touched = [r["b"] for r in wanted.select(self.bucket().alias("b")).distinct().collect()]
        return self._read(version, touched).join(wanted.select(*self.keys).distinct(), self.keys, "left_semi")

    def change(self, rows: DataFrame, merge: Merge, writer: str = "", batch: int = -1, schema: StructType | None = None) -> bool:
        """Puts ``merge(stored, rows)`` in the place of the buckets of the keys in ``rows``, of which ``stored`` has all rows; false if the writer's
        batch was there before. ``merge`` may only give rows of these buckets. Null keys are refused. ``schema``: of the store, for its first change, if ``rows``
        have another."""
        version = self.version()
        if batch >= 0 and version["writers"].get(writer, -1) >= batch:
            return False
        named = rows.select(*self.keys, self.bucket().alias("b"))
        touched = sorted((r["b"], r["bad"]) for r in named.groupBy("b").agg(F.max(~F.forall(F.array(*(F.col(f"`{k}`").isNotNull() for k in self.keys)), lambda x: x)).alias("bad")).collect())
        if any(bad for _, bad in touched):
            raise ValueError(f"a key of {self.keys} is null")
        numbers = [b for b, _ in touched]
        stored = self._read(version, numbers) if version["schema"] else self.spark.createDataFrame([], schema or rows.schema)
        merged, folder = merge(stored, rows), f"{version['number'] + 1:09d}-{uuid.uuid4().hex}"
        if numbers:
            merged.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        wrote = {n.removeprefix("bucket=") for n in self.files.names(f"{self.path}/data/{folder}") if n.startswith("bucket=")}
        if not wrote <= {str(b) for b in numbers}:
            raise ValueError("the merge gave rows of other buckets")
        folders = {b: f for b, f in version["folders"].items() if int(b) not in numbers} | {b: folder for b in sorted(wrote)}
        new = {"number": version["number"] + 1, "schema": merged.schema.jsonValue(), "folders": folders, "writers": version["writers"] | ({writer: batch} if batch >= 0 else {})}
        if not self.files.write_new(f"{self.path}/versions/{new['number']:09d}.json", json.dumps(new)):
            self.files.remove(f"{self.path}/data/{folder}")
            raise Conflict(f"version {new['number']} was written meanwhile")
        return True

    def upsert(self, rows: DataFrame, order: list[str] | None = None, writer: str = "", batch: int = -1) -> bool:
        """Rows replace or join those of their key; columns that they lack stay. Several rows of a key: as ``sync.upsert``."""
        (key,) = self.keys
        return self.change(rows, lambda stored, new: sync.upsert(stored, new, key, order), writer, batch)

    def delete(self, keys: DataFrame, writer: str = "", batch: int = -1) -> bool:
        """Rows of these keys go; keys that aren't there have no effect."""
        return self.change(keys, lambda stored, gone: stored.join(gone.select(*self.keys).distinct(), self.keys, "left_anti"), writer, batch)

    def replace_sets(self, rows: DataFrame, writer: str = "", batch: int = -1, senders: DataFrame | None = None) -> bool:
        """Every key in ``rows`` has just these rows afterwards; ``senders`` also names keys that have none."""
        touched = rows.select(*self.keys) if senders is None else rows.select(*self.keys).union(senders.select(*self.keys))
        return self.change(touched, lambda stored, sent: stored.join(sent.distinct(), self.keys, "left_anti").unionByName(rows), writer, batch, rows.schema)

    def keep_latest(self, rows: DataFrame, order: list[str], writer: str = "", batch: int = -1) -> bool:
        """The last row of each key by ``order``, of those stored and these: late rows replace nothing newer."""
        return self.change(rows, lambda stored, new: sync.latest(stored.unionByName(new), self.keys, order), writer, batch)

    def apply_log(self, log: DataFrame, order: list[str], removal: str, writer: str = "", batch: int = -1) -> bool:
        """Writes and removals, the last of each key counts; rows of the log have the boolean ``removal`` besides the stored columns and ``order``."""
        return self.change(log, lambda stored, new: sync.with_log(stored, new, self.keys, order, removal), writer, batch, log.drop(removal).schema)

    def vacuum(self, keep: int = 1) -> None:
        """Removes all but the last ``keep`` versions, and every bucket's folder that none of these names; no
        change may be under way."""
        numbers = self.versions()
        kept = {(f, f"bucket={b}") for n in numbers[-keep:] for b, f in self.version(n)["folders"].items()}
        for n in numbers[:-keep]:
            self.files.remove(f"{self.path}/versions/{n:09d}.json")
        for folder in self.files.names(f"{self.path}/data"):
            parts = self.files.names(f"{self.path}/data/{folder}")
            if gone := [p for p in parts if (folder, p) not in kept and p.startswith("bucket=")]:
                whole = len(gone) == sum(p.startswith("bucket=") for p in parts)
                for name in [folder] if whole else [f"{folder}/{p}" for p in gone]:
                    self.files.remove(f"{self.path}/data/{name}")
