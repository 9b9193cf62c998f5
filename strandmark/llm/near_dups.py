"""Near-duplicates: ProbMinHash signatures of shingles, banding, exact verification (operator 8)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmark.llm.frames import grams, hashed_texts, map_rows, mixed, slices, tidy, written

#: Members of a bucket that one block holds, and bytes of their shingles; either bounds it. Blocks are compared in tiles.
BLOCK, BLOCK_BYTES, TILE = 256, 1 << 20, 64
#: Shingles of which the arrivals are drawn at once.
ARRIVALS = 1 << 18


def shingles(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """Distinct ``n``-word shingles of each text (sorted hashes); a text with fewer words is one shingle, one without words has none."""
    hashes, counts = hashed_texts(texts)
    whole, out, at = grams(hashes, n), [], 0
    for count in counts.tolist():
        found = whole[at : at + count - n + 1] if count >= n else grams(hashes[at : at + count], max(1, count))
        found.sort()  # texts have no gram of ``whole`` in common
        out.append(found[np.r_[True, found[1:] != found[:-1]]] if count > n else found)
        at += count
    return out


def prob_minhash(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, docs: int, registers: int) -> np.ndarray:
    """Signatures (documents x registers) whose share of equal registers estimates the probability Jaccard similarity.

    Each element arrives by a Poisson process with its weight as rate; every arrival falls on a random register, which
    keeps the element that came first. All randomness is a function of element and arrival number. An element stops once it
    is later than the last register of its document: none of its later arrivals could matter.
    """
    best = np.full(docs * registers, np.inf)
    signature = np.zeros(docs * registers, np.uint64)
    last = np.full(docs, np.inf)
    for begin in range(0, len(elements), ARRIVALS):
        element, weight, owner = (x[begin : begin + ARRIVALS] for x in (elements, weights, doc))
        time, arrival = np.zeros(len(element)), 0
        while len(element):
            arrival += 1
            seed = mixed(element + np.uint64(arrival * 0x9E3779B97F4A7C15 % 2**64))
            time = time - np.log(((seed >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / weight
            keep = time < last[owner]
            element, weight, owner, time, seed = (x[keep] for x in (element, weight, owner, time, seed))
            at = owner * registers + (mixed(seed ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(best, at, time)
            first = best[at] == time
            signature[at[first]] = element[first]
            touched = np.unique(owner)
            last[touched] = best.reshape(docs, registers)[touched].max(axis=1)
    return signature.reshape(docs, registers)


def signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """doc_id, cls (digest of the text) and the hashes of the bands; without words there are none.

    Every distinct shingle has weight 1: then the probability Jaccard similarity is that of the sets, by which links are verified.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, limit=1 << 20):
            sets = shingles(piece.column(2).cast(pa.binary()).to_pylist())
            sizes = [*map(len, sets)]
            doc = np.repeat(np.arange(len(sets)), sizes)
            elements = np.concatenate(sets)
            hashes = prob_minhash(elements, np.ones(len(elements)), doc, len(sets), bands * rows).reshape(len(sets), bands, rows)
            key = np.zeros((len(sets), bands), np.uint64) + np.arange(bands, dtype=np.uint64)
            for k in range(rows):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + hashes[:, :, k])
            lists = [k if n else [] for k, n in zip(key.view(np.int64).tolist(), sizes)]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(lists, pa.list_(pa.int64()))], ["doc_id", "cls", "bands"])

    return docs.select("doc_id", F.unhex(F.md5("text")).alias("cls"), "text").mapInArrow(tidy(run), "doc_id long, cls binary, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, repeated: bool) -> DataFrame:
    """cls and shingles (sorted hashes as bytes) for the classes in ``wanted`` (cls, rep); ``repeated``: rows may be equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, limit=1 << 20):
            sets = [x.tobytes() for x in shingles(piece.column(1).cast(pa.binary()).to_pylist())]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sets, pa.binary())], ["cls", "shingles"])

    of = docs.select(F.col("doc_id").alias("rep"), F.unhex(F.md5("text")).alias("cls"), "text").join(wanted, ["rep", "cls"])
    return (of.dropDuplicates(["rep", "cls"]) if repeated else of).select("cls", "text").mapInArrow(tidy(run), "cls binary, shingles binary")


def verified(pairs: DataFrame, sets: DataFrame, label: str) -> DataFrame:
    """a, b and the Jaccard similarity of their shingle sets. A set moves once a pair; hot leaders are split by AQE."""

    def make():
        def work(rows: dict) -> dict:
            out = []
            for x, y in zip(rows["x"], rows["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                out.append(both / (len(x) + len(y) - both))
            return {"a": rows["a"], "b": rows["b"], "j": out}

        return work

    joined = pairs.join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a")
    return written(map_rows(joined.select("a", "b", "x", "y"), make, "a binary, b binary, j double"), label)


def common(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Shingles that each member of ``x`` has in common with each of ``y``, by matrix products over ranges of shingles."""
    every = np.unique(np.concatenate([*x, *y]))
    total = np.zeros((len(x), len(y)), np.int64)
    for begin in range(0, len(every), 1 << 14):
        part = every[begin : begin + (1 << 14)]

        def rows(z: list[np.ndarray]) -> np.ndarray:
            has = np.zeros((len(z), len(part)), np.float32)
            for i, s in enumerate(z):
                inside = s[np.searchsorted(s, part[0]) : np.searchsorted(s, part[-1], side="right")]
                has[i, np.searchsorted(part, inside)] = 1
            return has

        total += np.rint(rows(x) @ rows(y).T).astype(np.int64)
    return total


def linked(blocks: DataFrame, least: float) -> DataFrame:
    """a, b and their Jaccard similarity where it is ``least`` or more, for members of a block x with those of y (or, if y
    is null, among themselves) that are in different components. Only links come out."""

    def tiles(members: list) -> Iterator[tuple[list, list]]:
        members = sorted(members, key=lambda m: len(m["shingles"]))  # then tiles whose sizes differ too much are passed over
        for i in range(0, len(members), TILE):
            yield members[i : i + TILE], [np.frombuffer(m["shingles"], np.uint64) for m in members[i : i + TILE]]

    def make():
        def work(rows: dict) -> dict:
            out = {"a": [], "b": [], "j": []}
            for x, y in zip(rows["x"], rows["y"]):
                left = [*tiles(x)]
                right = left if y is None else [*tiles(y)]
                for p, (mx, sx) in enumerate(left):
                    for my, sy in right[p:] if y is None else right:
                        if len(sx[-1]) < least * len(sy[0]) or len(sy[-1]) < least * len(sx[0]):
                            continue
                        both = common(sx, sy)
                        j = both / (np.array([*map(len, sx)])[:, None] + np.array([*map(len, sy)])[None] - both)
                        for i, k in zip(*np.nonzero(j >= least)):
                            if mx[i]["comp"] != my[k]["comp"] and (mx is not my or i < k):
                                a, b = sorted((mx[i]["cls"], my[k]["cls"]))
                                out["a"].append(a)
                                out["b"].append(b)
                                out["j"].append(float(j[i, k]))
            return out

        return work

    return map_rows(blocks, make, "a binary, b binary, j double")


def components(edges: DataFrame) -> DataFrame:
    """cls, comp: the least member of each connected component; only for nodes with an edge.

    Least labels spread along edges, and each label is replaced by its own label, so that long chains halve. A hub is one
    key of a sum and of a join; both are combined or split before one task holds it.
    """
    edges = written(edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v"), "edges")
    labels = written(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("comp")).withColumnRenamed("u", "cls"), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("cls", "v"), "v").groupBy("u").agg(F.min("comp").alias("near")).withColumnRenamed("u", "cls")
        spread = labels.join(near, "cls").select("cls", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("cls").alias("comp"), F.col("comp").alias("beyond"))
        new = written(spread.join(jump, "comp", "left").select("cls", "old", F.least("comp", F.coalesce("beyond", "comp")).alias("comp")), "labels")
        changed = bool(new.filter("comp <> old").limit(1).count())
        labels = new.select("cls", "comp")
        if not changed:
            return labels


def near_duplicates(docs: DataFrame, similarity: float = 0.8, bands: int = 16, rows: int = 4) -> DataFrame:
    """doc_id, class_id, copy_id, n_spanning_links of every row, as ``near_classes`` finds them."""
    return near_classes(docs, similarity, bands, rows).drop("cls")


def near_classes(docs: DataFrame, similarity: float = 0.8, bands: int = 16, rows: int = 4) -> DataFrame:
    """doc_id, cls (digest of the text), class_id, copy_id, n_spanning_links of every row.

    ``copy_id`` is the least doc_id with the very same text; ``class_id`` the least doc_id of the near-duplicate class, a
    connected component of links: pairs of different texts whose sets of five-word shingles have a Jaccard similarity
    of ``similarity`` or more. ``n_spanning_links`` counts the links of the row's text that were verified, enough of them
    to span each class, not all. Candidates are texts with an equal band of
    ProbMinHash registers over their sets of shingles, however often these occur; 16 bands of 4 find a pair at 0.8 with probability 0.9998.

    Exact copies meet as one class before anything is compared. Every text is compared with the least of its leaders first.
    Buckets aren't expanded into pairs: those whose members aren't in one component then are cut into blocks of
    bounded size in members and bytes, blocks meet, and only links between components come out. So no link that would join two is lost.
    Null texts are classes of their own; empty texts, and texts of white space, have no shingles and are duplicates only of exact
    copies; rows with a null doc_id take part through their texts, a class that has no id at all has a null class_id; repeated rows
    stay rows; an empty table gives no rows; other columns aren't read.
    """
    docs = docs.select("doc_id", "text")
    signed = written(signatures(docs.filter("text is not null"), bands, rows), "signatures")
    classes = written(signed.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    filed = classes.filter("rep is not null").select("cls", "rep", F.explode("bands").alias("key"))
    buckets = filed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("rep", "cls")).alias("lead")).filter("n > 1")
    members = written(filed.join(buckets, "key").select("key", "cls", "rep", "n", F.col("lead.rep").alias("lead_rep"), F.col("lead.cls").alias("lead")), "members")
    repeated = bool(signed.groupBy("doc_id", "cls").count().filter("count > 1").limit(1).count())
    sets = written(shingle_sets(docs, members.select("cls", "rep").distinct(), repeated), "shingles")

    # first everyone with the least of its leaders
    first = members.filter("cls <> lead").groupBy("cls").agg(F.min(F.struct("lead_rep", "lead")).alias("l")).select(F.col("l.lead").alias("a"), F.col("cls").alias("b"))
    checked = verified(first, sets, "verified")
    labels = components(checked.filter(F.col("j") >= similarity))
    # then, in buckets of several components, blocks of members with each other
    known = members.select("key", "cls").join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    several = known.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 <> c2").select("key")
    sized = written(known.join(several, "key").join(sets.select("cls", F.octet_length("shingles").alias("size")), "cls"), "sized")
    needed = sized.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_BYTES)).alias("blocks"))
    placed = sized.drop("size").join(needed, "key").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    blocks = written(placed.join(sets, "cls").groupBy("key", "blocks", "block").agg(F.collect_list(F.struct("cls", "comp", "shingles")).alias("x")), "blocks")
    # every two blocks of a bucket meet under a key of their own
    later = blocks.filter("block < blocks - 1").select("key", "block", F.explode(F.expr("sequence(block + 1, blocks - 1)")).alias("other"), "x")
    earlier = blocks.filter("block > 0").select("key", F.explode(F.expr("sequence(0L, block - 1)")).alias("block"), F.col("block").alias("other"), F.col("x").alias("y"))
    across = later.join(earlier, ["key", "block", "other"]).select("x", "y")
    own = blocks.select("x", F.lit(None).cast(blocks.schema["x"].dataType).alias("y"))
    found = linked(own.unionByName(across), similarity)
    checked = written(checked.unionByName(found.groupBy("a", "b").agg(F.max("j").alias("j")).join(checked.select("a", "b"), ["a", "b"], "left_anti")), "checked")
    labels = components(checked.filter(F.col("j") >= similarity))

    links = checked.filter(F.col("j") >= similarity)
    counts = links.select(F.col("a").alias("cls")).union(links.select("b")).groupBy("cls").agg(F.count("*").alias("n_spanning_links"))
    named = labels.join(classes.select("cls", "rep"), "cls").groupBy("comp").agg(F.min("rep").alias("class_id"))
    of_class = classes.select("cls", F.col("rep").alias("copy_id")).join(labels, "cls", "left").join(named, "comp", "left").join(counts, "cls", "left")
    of_class = of_class.select("cls", "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"), F.coalesce("n_spanning_links", F.lit(0)).alias("n_spanning_links"))
    found = signed.select("doc_id", "cls").join(of_class, "cls").select("doc_id", "cls", "class_id", "copy_id", "n_spanning_links")
    alone = docs.filter("text is null").select("doc_id", F.lit(None).cast("binary").alias("cls"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_spanning_links"))
    return found.unionByName(alone)


def keep_one_of_each(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't near-duplicates of a smaller doc_id; rows with a null id stay.

    A row goes by its id and its text: another text under the same id stays. Null texts and texts without words stay, but for exact
    copies of the latter; of equal rows all stay or all go; ties don't occur, as ids are ordered; an empty table gives no rows; other
    columns, whatever their names, come through as they are. A very long text is held by its own task alone, for its shingles.
    """
    gone = near_classes(docs, similarity).filter("doc_id <> class_id").select(F.col("doc_id").alias("gone_id"), F.col("cls").alias("gone_cls")).distinct()
    same = (docs["doc_id"] == gone["gone_id"]) & (F.unhex(F.md5(docs["text"])) == gone["gone_cls"])
    return docs.join(gone, same, "left_anti")
