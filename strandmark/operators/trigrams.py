"""Substring search by trigrams: an index of texts for all-words search, and a join of places with many names."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from strandmark.functions.text import blank, normalize
from strandmark.sources.folders import Files, fresh_folder

#: Characters of a text that are taken apart at once, and grams that a batch of rows holds about.
PIECE, BATCH = 1 << 20, 1 << 17


def gram_code(characters: str) -> int:
    """A gram of up to three characters as one number: their code points, 21 bits each."""
    return sum(ord(c) << 21 * i for i, c in enumerate(characters))


def codes(text: str, n: int) -> np.ndarray:
    """The different grams of ``n`` characters of a text, as ``gram_code`` numbers them."""
    found = []
    for at in range(0, max(1, len(text) - n + 1), PIECE):
        points = np.frombuffer(text[at : at + PIECE + n - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        count = len(points) - n + 1
        if count > 0:
            code = points[:count].copy()
            for i in range(1, n):
                code |= points[i : i + count] << 21 * i
            found.append(np.unique(code))
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0] if found else np.empty(0, np.int64)


#: Characters of texts whose postings are put together by one call.
TOGETHER = 1 << 21


def postings_of(rows: DataFrame, key: str, text: str) -> DataFrame:
    """gram, keys and n: the grams of three characters with the keys of all texts of a batch that have it, so that a gram moves once a batch, not once
    a text. A text counts once a gram; of a key with several texts each counts."""
    kind = rows.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(batch.schema.get_field_index(key)), batch.column(batch.schema.get_field_index(text))
            held, owners, size = [], [], 0
            for i in range(batch.num_rows + 1):
                if held and (i == batch.num_rows or size > TOGETHER):
                    grams, of = np.concatenate(held), np.repeat(owners, [*map(len, held)])
                    order = np.argsort(grams, kind="stable")
                    different, starts = np.unique(grams[order], return_index=True)
                    ends = np.append(starts, len(grams)).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), keys.take(pa.array(of[order])))
                    yield pa.RecordBatch.from_arrays([pa.array(different), lists, pa.array(np.diff(ends).astype(np.int64))], ["gram", "keys", "n"])
                    held, owners, size = [], [], 0
                if i < batch.num_rows and (read := texts[i].as_py()) is not None:
                    held.append(codes(read, 3))
                    owners.append(i)
                    size += len(read)

    return rows.select(key, text).mapInArrow(run, StructType([StructField("gram", LongType()), StructField("keys", ArrayType(kind)), StructField("n", LongType())]))


#: Buckets of grams, of which a set is a table of a megabyte whatever the number of grams.
BUCKETS = 1 << 20


def bucket(gram):
    """The bucket of a gram; the same for columns and for arrays."""
    part = lambda shift: (F.shiftright(gram, shift).bitwiseAND(F.lit(BUCKETS - 1)) if isinstance(gram, Column) else gram >> shift & BUCKETS - 1)
    mixed = part(0) + part(21) * 37 + part(42) * 1369
    return mixed % BUCKETS


def bucket_set(grams: DataFrame, column: str) -> np.ndarray:
    """Which buckets the grams of a column are in: BUCKETS numbers at most come to the driver."""
    held = np.zeros(BUCKETS, bool)
    held[[r[0] for r in grams.select(bucket(F.col(column))).distinct().collect()]] = True
    return held


def with_grams(rows: DataFrame, text: str, lengths: list[int], among: np.ndarray | None = None) -> DataFrame:
    """The other columns of ``rows`` with ``gram``, a row for each different gram of these lengths in the text; null texts have none.
    ``among``: only grams in these buckets.

    Positions of a text aren't worth a row of JVM objects each: a task turns code points into numbers, array by array.
    """
    others = [f for f in rows.schema if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, owners, size = [], [], 0
            texts = batch.column(batch.schema.get_field_index(text))
            for i in range(batch.num_rows + 1):
                if size > BATCH or i == batch.num_rows and held:
                    at = pa.array(np.repeat(owners, [*map(len, held)]))
                    yield pa.RecordBatch.from_arrays([*(batch.column(f.name).take(at) for f in others), pa.array(np.concatenate(held))], [*(f.name for f in others), "gram"])
                    held, owners, size = [], [], 0
                if i < batch.num_rows and (read := texts[i].as_py()) is not None:
                    for n in lengths:
                        found = codes(read, n)
                        held.append(found if among is None else found[among[bucket(found)]])
                        owners.append(i)
                        size += len(held[-1])

    return rows.mapInArrow(run, StructType([*others, StructField("gram", LongType())]))


@dataclass
class TextIndex:
    """Where an index lies: ``texts`` (key, norm; a folder for each of ``shards`` hashes of the key), ``postings`` (gram, keys and their number, by gram;
    several rows a gram), ``counts`` (gram, n)."""

    spark: SparkSession
    path: str
    key: str
    shards: int

    def shard(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.shards)).cast("int")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def build_index(rows: DataFrame, key: str, text: str, path: str, shards: int = 64) -> TextIndex:
    """Writes the index of a table's texts, normalised as search reads them; null texts are empty.

    Postings are ranged by gram and first key, so a frequent gram is spread over many files and a rare one is in one, whose statistics say
    so: a search reads the row groups of its few grams. Texts lie in a folder for each of ``shards`` hashes of the key, and a search
    opens those of its candidates. Rows of one key are one entry if their texts are equal, else entries of their own.
    """
    index = TextIndex(rows.sparkSession, path, key, shards)
    read = rows.select(key, normalize(blank(text)).alias("norm")).withColumn("shard", index.shard())
    read.repartition("shard", F.pmod(F.xxhash64(key, "norm"), F.lit(8))).write.partitionBy("shard").parquet(f"{path}/texts")
    postings_of(index.table("texts"), key, "norm").write.parquet(f"{path}/batches")  # once: ranging reads its rows twice
    ranged = index.table("batches").repartitionByRange("gram", F.element_at("keys", 1))
    ranged.sortWithinPartitions("gram").write.parquet(f"{path}/postings")
    index.table("postings").groupBy("gram").agg(F.sum("n").alias("n")).write.parquet(f"{path}/counts")
    Files(index.spark, path).remove(f"{path}/batches")
    return index


@dataclass
class Asked:
    """Queries as the index takes them: words of each, and the grams that a row must have; None: no word is long enough."""

    words: list[list[str]]
    chosen: list[list[int] | None]


def asked(index: TextIndex, queries: list[str], most: int = 2) -> Asked:
    """Looks up how frequent the queries' grams are, and takes the ``most`` rarest of each word."""
    split = [[w for w in regex.split(r"[\s\p{Z}]+", q or "") if w] for q in queries]
    flat = [(i, w) for i, ws in enumerate(split) for w in ws]
    words: list[list[str]] = [[] for _ in queries]
    if flat:
        for r in index.spark.createDataFrame(flat, "i int, w string").select("i", normalize("w").alias("w")).collect():
            words[r["i"]].append(r["w"])
    of = lambda w: codes(w, 3).tolist()
    every = sorted({g for ws in words for w in ws for g in of(w)})
    n = {r["gram"]: r["n"] for r in index.table("counts").filter(F.col("gram").isin(every)).collect()} if every else {}
    long = [[w for w in ws if len(w) > 2] for ws in words]
    chosen = [sorted({g for w in ws for g in sorted(of(w), key=lambda g: (n.get(g, 0), g))[:most]}) if ws else None for ws in long]
    return Asked(words, chosen)


def candidates(index: TextIndex, found: Asked) -> DataFrame:
    """query, shard and key of the rows that have all chosen grams of a query. Only the postings of these grams are read."""
    wanted: dict[int, list[int]] = {}
    for i, chosen in enumerate(found.chosen):
        for g in chosen or []:
            wanted.setdefault(g, []).append(i)
    lists = [x for g, numbers in sorted(wanted.items()) for x in (F.lit(g), F.array(*map(F.lit, numbers)))]
    hits = index.table("postings").filter(F.col("gram").isin(sorted(wanted))).select("gram", F.explode("keys").alias(index.key))
    of = hits.select(F.explode(F.element_at(F.create_map(*lists), F.col("gram"))).alias("query"), index.key, "gram") if wanted else hits.select(F.lit(0).alias("query"), index.key, "gram")
    needed = F.get(F.array(*(F.lit(len(c or [])) for c in found.chosen)), F.col("query"))
    return of.groupBy("query", index.key).agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == needed).select("query", index.shard().alias("shard"), index.key)


def search(index: TextIndex, queries: list[str]) -> DataFrame:
    """query (its position) and key of the rows in whose text every word of the query is a substring; a blank query finds all.

    Rows are those of ``search.all_words``. Candidates have the rarest trigrams of each word; their texts alone are read and checked for whole
    words. A query without a word of three characters is checked against all texts.
    """
    if not queries:
        raise ValueError("no queries")
    found = asked(index, queries)
    words = F.array(*(F.array(*map(F.lit, ws)) if ws else F.array().cast("array<string>") for ws in found.words))
    holds = lambda q: F.forall(F.get(words, q), lambda w: F.contains("norm", w))
    result = None
    if any(c is not None for c in found.chosen):
        near = candidates(index, found)
        shards = sorted(r["shard"] for r in near.select("shard").distinct().collect())
        texts = index.table("texts").filter(F.col("shard").isin(shards)) if shards else index.table("texts").filter("false")
        near = near.select("query", F.col("shard").alias("_shard"), F.col(index.key).alias("_key"))
        met = texts.join(near, (texts["shard"] == near["_shard"]) & texts[index.key].eqNullSafe(near["_key"]))
        result = met.filter(holds(F.col("query"))).select("query", index.key)
    if scanned := [i for i, c in enumerate(found.chosen) if c is None]:
        hits = index.table("texts").select(F.explode(F.filter(F.array(*map(F.lit, scanned)), holds)).alias("query"), index.key)
        result = hits if result is None else result.unionByName(hits)
    return result


#: Lengths under which names are filed, if they have more than 16 different ones: no more than 16 either.
STEPS = [*range(1, 9), *(1 << i for i in range(4, 12))]
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def _slots(sums: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Buckets of the windows of ``n`` characters at these places; ``sums`` are running sums of the characters times powers of the base."""
    x = (sums[at + n] - sums[at]) * _powers(2 * PIECE)[1][at]
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x >> np.uint64(44)).astype(np.int64)


def _sums(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(points * _powers(2 * PIECE)[0][: len(points)], out=sums[1:])
    return sums


def _joined(texts: list[str], overlap: int) -> Iterator[tuple[list[int], str, np.ndarray]]:
    """Texts behind each other, about PIECE characters at once: their numbers, the characters, and where each begins; the end comes last. A longer text
    comes in pieces that overlap."""
    held: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate([*texts, None]):
        for at in range(0, max(1, len(text) - overlap), PIECE) if text is not None else [None]:
            if held and (at is None or size + min(len(text) - at, PIECE + overlap) > 2 * PIECE - 1):
                yield [o for o, _ in held], "".join(t for _, t in held), np.cumsum([0, *(len(t) for _, t in held)])
                held, size = [], 0
            if at is not None:
                held.append((i, text[at : at + PIECE + overlap]))
                size += len(held[-1][1])


class Filed:
    """Under which grams names are filed: for a place of a text, bits say for which lengths some gram may begin as the text does there, end as
    it does and be equal to it. Three tables of a fixed size, whatever the number of names."""

    def __init__(self, steps: list[int]):
        self.steps = steps
        self.masks = np.zeros((3, BUCKETS), np.uint16)

    def marks(self, grams: list[str]) -> np.ndarray:
        """table, bucket and bit of these grams."""
        found = [np.empty((3, 0), np.int64)]
        for k, n in enumerate(self.steps):
            m = min(3, n)
            for _, text, begins in _joined([g for g in grams if len(g) == n], 0):
                sums, at = _sums(text), begins[:-1]
                for t, slots in enumerate((_slots(sums, at, m), _slots(sums, at + n - m, m), _slots(sums, at, n))):
                    slots = np.unique(slots)
                    found.append(np.stack([np.full(len(slots), t), slots, np.full(len(slots), 1 << k)]))
        return np.concatenate(found, axis=1)

    def learn(self, grams: DataFrame, column: str) -> Filed:
        """The tables from a column of grams: tasks mark buckets, of which no more than the tables have come to the driver."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in self.marks(batch.column(0).to_pylist())], ["t", "slot", "bit"])

        marks = grams.select(column).mapInArrow(run, "t long, slot long, bit long").groupBy("t", "slot").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.masks[marks["t"].to_numpy(), marks["slot"].to_numpy()] = marks["bits"].to_numpy().astype(np.uint16)
        return self

    def offered(self, texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
        """Numbers of texts and grams in them that may be filed; each of a text once or more."""
        first, end, same = self.masks
        for owners, text, begins in _joined(texts, max(self.steps) - 1):
            sums, found = _sums(text), {}
            ends = np.repeat(begins[1:], np.diff(begins))  # where the text of each character ends
            slots: dict[int, np.ndarray] = {}
            for k, n in enumerate(self.steps):
                m, bit = min(3, n), np.uint16(1 << k)
                if m not in slots:
                    slots[m] = _slots(sums, np.arange(max(0, len(text) - m + 1)), m)
                at = np.flatnonzero(first[slots[m]] & bit)
                at = at[at + n <= ends[at]]
                at = at[(end[slots[m][at + n - m]] & bit) > 0]
                at = at[(same[_slots(sums, at, n)] & bit) > 0]
                of = np.searchsorted(begins, at, "right") - 1
                found |= dict.fromkeys((owners[o], text[i : i + n]) for o, i in zip(of.tolist(), at.tolist()))
            if found:
                yield [o for o, _ in found], [g for _, g in found]


def _offered(texts: DataFrame, filed: Filed) -> DataFrame:
    """_id and _gram: the grams of texts (_id, _text) under which names may be filed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owners, grams in filed.offered(batch.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners)), pa.array(grams)], ["_id", "_gram"])

    return texts.select("_id", "_text").mapInArrow(run, "_id binary, _gram string")


def containing(rows: DataFrame, names: DataFrame, text: str, name: str) -> DataFrame:
    """Rows whose text contains some name; a null text contains none, a null name is in none, the empty name is in every text.

    Names are filed by their length, whole, and texts offer what they hold in these lengths, as far as tables of a fixed size let it
    through, which know the names' first and last three characters and the whole. Where both meet, the text has the name: pairs are only those that
    match, however much names resemble each other. With more than 16 lengths, a name of another length than ``STEPS`` is filed under its rarest gram of the
    next lower one, and texts that have it are checked. Texts go by their digest, and move only for that check.
    """
    wanted = names.select(F.col(name).alias("_name")).filter("_name is not null")
    lengths = {r[0] for r in wanted.select(F.length("_name")).distinct().collect()}
    if 0 in lengths or not lengths:
        return rows.filter(F.col(text).isNotNull() if lengths else F.lit(False))
    steps = sorted(lengths if len(lengths) <= 16 else {max(s for s in STEPS if s <= n) for n in lengths})
    texts = rows.select(F.unhex(F.md5(text)).alias("_id"), F.col(text).alias("_text")).filter("_text is not null")
    n = F.length("_name")
    whole = wanted.filter(n.isin(steps)).select(F.col("_name").alias("_gram"))
    offered = _offered(texts, Filed(steps).learn(whole, "_gram"))
    held = offered.join(whole, "_gram", "left_semi").select("_id")
    if lengths - {*steps}:
        step = F.array_max(F.filter(F.array(*map(F.lit, steps)), lambda s: s <= F.length("_name")))
        cut = lambda s: F.transform(F.sequence(F.lit(1), F.length("_name") - s + 1), lambda i: F.substring(F.col("_name"), i, s))
        parts = wanted.filter(~n.isin(steps)).distinct().select("_name", F.explode(F.array_distinct(cut(step))).alias("_gram"))
        counts = _offered(texts, Filed(steps).learn(parts, "_gram")).groupBy("_gram").agg(F.count("*").alias("_n"))
        rarest = parts.join(counts, "_gram", "left").groupBy("_name").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "_gram")).alias("_r"))
        path = fresh_folder(rows.sparkSession, "filed")
        rarest.filter("_r._n > 0").select("_name", "_r._gram").write.parquet(path)  # a gram that no text has: nor has any text the name
        filed = rows.sparkSession.read.parquet(path)
        met = _offered(texts, Filed(steps).learn(filed, "_gram")).join(filed, "_gram").select("_id", "_name").distinct()
        held = held.union(met.join(texts, "_id").filter(F.contains("_text", "_name")).select("_id"))
    named_by = rows.withColumn("_digest", F.unhex(F.md5(text)))
    held = held.distinct().withColumnRenamed("_id", "_held")
    return named_by.join(held, named_by["_digest"] == held["_held"], "left_semi").drop("_digest")
