"""Small helpers shared by the corpus operators: Arrow iteration in bounded pieces and stable hashes."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Text handled at once inside a task; bounds the temporary arrays of a Python worker.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one input table; the path goes only to Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each piece holds about ``limit`` bytes of ``text`` (one row at least; without that column, of the
    whole batch)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if text not in batch.schema.names:
            step = max(1, limit * batch.num_rows // max(1, batch.nbytes))
            yield from (batch.slice(i, step) for i in range(0, batch.num_rows, step))
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        at, total = 0, 0
        for i, size in enumerate(sizes):
            if total and total + size > limit:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += int(size)
        yield batch.slice(at)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; elsewhere only Arrow's memory is given back


def give_back() -> None:
    """Hands freed memory back to the system: a Python worker outlives its task, and other workers need the room."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


#: What ``mapInArrow`` takes, and what ``applyInArrow`` takes for groups and for pairs of groups.
Batches, Group, Pair = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], Callable[[pa.Table], pa.Table], Callable[[pa.Table, pa.Table], pa.Table]


def tidy(run: Batches) -> Batches:
    """``run``, after which a task gives back the memory that it freed."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


@contextmanager
def no_cycles() -> Iterator[None]:
    """Without the collector of cycles: what groups hold has none, and looking through millions of small objects for them takes long."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def tidy_group(run: Group) -> Group:
    def tidied(rows: pa.Table) -> pa.Table:
        with no_cycles():
            found = run(rows)
        give_back()
        return found

    return tidied


def tidy_pair(run: Pair) -> Pair:
    def tidied(left: pa.Table, right: pa.Table) -> pa.Table:
        with no_cycles():
            found = run(left, right)
        give_back()
        return found

    return tidied


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over slices given as dicts of Python lists. ``make`` runs once in each task."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for piece in slices(batches, limit=limit):
            out = work({name: piece.column(i).to_pylist() for i, name in enumerate(piece.schema.names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(tidy(run), schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that sums of products become usable hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Text whose words are hashed at once; the arrays of a chunk take about 60 bytes a byte.
CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of the bytes, powers of the base and of its inverse modulo 2 ** 64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)), np.cumprod(up), np.cumprod(down)


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space."""
    space = np.ones(len(raw) + 2, bool)
    space[1:-1] = SPACE[raw]
    return np.flatnonzero(space[:-2] & ~space[1:-1]), np.flatnonzero(~space[1:-1] & space[2:]) + 1


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable 64-bit hash of each word, with the words' starts and ends; chunk after chunk, without a table of words.

    The hash is a polynomial in the bytes: differences of a running sum, moved to the power 0. Words of a chunk or more
    have a hash of their own kind.
    """
    values, up, down = _powers(CHUNK_BYTES)
    found = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    at = 0
    while at < len(data):
        raw = np.frombuffer(data, np.uint8, min(CHUNK_BYTES, len(data) - at), at)
        gaps = np.flatnonzero(SPACE[raw])
        if len(raw) == CHUNK_BYTES and not len(gaps):
            after = _WHITE.search(data, at + CHUNK_BYTES)
            end = after.start() if after else len(data)
            more = [xxhash.xxh3_64_intdigest(memoryview(data)[at:end])], [at], [end]
        else:
            if at + len(raw) < len(data):
                raw = raw[: gaps[-1] + 1]
            end = at + len(raw)
            starts, ends = word_spans(raw)
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(values[raw] * up[: len(raw)], out=sums[1:])
            more = mixed((sums[ends] - sums[starts]) * down[starts]), starts + at, ends + at
        for kind, x in zip(found, more):
            kind.append(np.asarray(x, kind[0].dtype))
        at = end
    hashes, starts, ends = map(np.concatenate, found)
    return hashes, starts, ends


def hashed_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of all texts in a row, and each text's number of words."""
    hashes, starts, _ = word_hashes(b"\n".join(texts))
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.diff(np.searchsorted(starts, begins))


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` symbols; empty when there are fewer."""
    count = len(ids) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = ids[:count].copy()
    for i in range(1, n):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += ids[i : i + count]
    return mixed(out)


#: Bytes of rows that go to a Python worker at once where a table is written.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder below spark.checkpoint.dir, the store that driver and executors share.

    Only on a single machine a folder below /tmp serves where that setting is absent.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/strandmark-checkpoints"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written_to(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Cuts the lineage: writes a table to the shared store and reads it back; with its folder. Rows reach Python in small batches
    meanwhile, since a row can be large here; the session's setting comes back afterwards."""
    spark = df.sparkSession
    path, before = scratch(spark, label), spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(BATCH_SETTING, before)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    return written_to(df, label)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Removes a written table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
