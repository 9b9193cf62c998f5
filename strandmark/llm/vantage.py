"""Nearest neighbours by cosine: vantage-point trees of shards, pruned by the triangle inequality (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmark.llm.frames import slices, tidy, written

#: Vectors of a shard, of a tree's leaf, and queries that one copy of a shard answers, in batches.
SHARD, LEAF, ANSWERED, BATCH = 4096, 48, 16_384, 1024
#: Cells at most; each lies around a vector of the sample, which comes to the driver.
CELLS = 4096
#: Rounding of cosines may move a distance (the chord of unit vectors) by this much; bounds are widened by it.
EPSILON, COSINE = 1e-6, 1e-9


def vectors_of(rows: DataFrame, vector: str, components: int) -> DataFrame:
    """vec_id and v of the rows that take part: an id, ``components`` components, all finite, not all zero."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows.filter(F.col("vec_id").isNotNull() & (F.size(x) == components) & finite & F.exists(x, lambda c: c != 0)).select("vec_id", x.alias("v"))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def squares(x: np.ndarray) -> np.ndarray:
    """Squared norms, summed component after component, so that a vector has the same one wherever it stands."""
    total = np.zeros(len(x))
    for i in range(x.shape[1]):
        total += x[:, i] * x[:, i]
    return total


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(squares(x))[:, None]


def cosines(x: np.ndarray, y: np.ndarray, xx: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``x`` with that of ``y``, whose squared norms are given, in one order of summation."""
    dot = np.zeros(len(x))
    for i in range(x.shape[1]):
        dot += x[:, i] * y[:, i]
    return np.clip(dot / np.sqrt(xx * yy), -1.0, 1.0)


def chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2 - 2 * cosine))


def chords_to(units: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.linalg.norm(units - point, axis=1)


@dataclass
class Tree:
    """Different vectors in the order of the leaves, the ids of each, and the nodes.

    A node is (vantage, inside, outside, begin, end) with the least and the greatest distance to the vantage point inside and outside;
    a leaf has a vantage of -1 and a range of vectors.
    """

    vectors: np.ndarray
    begins: np.ndarray
    ids: np.ndarray
    nodes: np.ndarray
    bounds: np.ndarray

    COLUMNS = "vectors binary, begins binary, ids binary, nodes binary, bounds binary"

    def packed(self) -> list[bytes]:
        return [x.tobytes() for x in (self.vectors, self.begins, self.ids, self.nodes, self.bounds)]

    @staticmethod
    def unpacked(parts: list[bytes], components: int) -> Tree:
        vectors, begins, ids, nodes, bounds = (np.frombuffer(x, kind) for x, kind in zip(parts, (np.float64, np.int64, np.int64, np.int64, np.float64)))
        return Tree(vectors.reshape(-1, components), begins, ids, nodes.reshape(-1, 5), bounds.reshape(-1, 4))


def build(ids: np.ndarray, x: np.ndarray, copies: int) -> Tree:
    """The tree of a shard. Equal vectors are one point with its ``copies`` least ids: no answer can hold more of them."""
    points, of = np.unique(x, axis=0, return_inverse=True)
    order = np.lexsort((ids, of.ravel()))
    of, ids = of.ravel()[order], ids[order]
    fresh = np.r_[True, (of[1:] != of[:-1]) | (ids[1:] != ids[:-1])]
    of, ids = of[fresh], ids[fresh]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    of, ids = of[rank < copies], ids[rank < copies]
    units = unit(points)
    nodes, bounds, leaves = [], [], []

    def grow(at: np.ndarray) -> int:
        number = len(nodes)
        nodes.append([-1, -1, -1, 0, 0])
        bounds.append([0.0] * 4)
        if len(at) > LEAF:
            vantage = at[np.argmax(chords_to(units[at], units[at[0]]))]
            rest = at[at != vantage]
            d = chords_to(units[rest], units[vantage])
            near = d <= np.median(d)
            if near.all():  # a tie at the median
                near = d < d.max()
            if 0.1 <= near.mean() <= 0.9:  # else nearly all are as far away, and no cut would leave much out
                bounds[number] = [d[near].min(), d[near].max(), d[~near].min(), d[~near].max()]
                leaves.append(np.array([vantage]))
                place = sum(map(len, leaves)) - 1
                nodes[number] = [place, grow(rest[near]), grow(rest[~near]), 0, 0]
                return number
        begin = sum(map(len, leaves))
        leaves.append(at)
        nodes[number] = [-1, -1, -1, begin, begin + len(at)]
        return number

    grow(np.arange(len(points)))
    placed = np.concatenate(leaves)
    counts = np.bincount(of, minlength=len(points))
    first = np.r_[0, np.cumsum(counts)]
    sizes = counts[placed]
    begins = np.r_[0, np.cumsum(sizes)]
    within = np.arange(begins[-1]) - np.repeat(begins[:-1], sizes)
    return Tree(points[placed], begins, ids[np.repeat(first[placed], sizes) + within], np.array(nodes), np.array(bounds))


class Answers:
    """The best of a batch of queries over one tree."""

    def __init__(self, tree: Tree, own: np.ndarray, x: np.ndarray, known: np.ndarray, k: int, factor: float):
        """``known``: a cosine that k others reach elsewhere (-2: none); what lies below it needn't be found."""
        self.tree, self.own, self.x, self.k, self.factor = tree, own, x, k, factor
        self.squares, self.tree_squares = squares(x), squares(tree.vectors)
        self.units, self.tree_units = x / np.sqrt(self.squares)[:, None], tree.vectors / np.sqrt(self.tree_squares)[:, None]
        self.score, self.ids = np.full((len(x), k), -np.inf), np.full((len(x), k), np.iinfo(np.int64).max)
        self.known, self.compared = known, np.zeros(len(x), np.int64)
        if (known < -1).any():
            self.descend(0, np.flatnonzero(known < -1))
        self.visit(0, np.arange(len(x)))

    def worst(self, q: np.ndarray) -> np.ndarray:
        return np.maximum(self.score[q, -1], self.known[q])

    def reach(self, q: np.ndarray) -> np.ndarray:
        """How far a better neighbour can lie, times the factor."""
        worst = self.worst(q)
        return np.where(worst < -1, np.inf, self.factor * chord(worst)) + EPSILON

    def look(self, q: np.ndarray, begin: int, end: int) -> None:
        """Compares queries with a range of points: products first, exact cosines of what may count."""
        self.compared[q] += end - begin
        a, b = np.nonzero(self.units[q] @ self.tree_units[begin:end].T >= (self.worst(q) - COSINE)[:, None])
        a, b = q[a], b + begin
        score = cosines(self.x[a], self.tree.vectors[b], self.squares[a], self.tree_squares[b])
        copies = self.tree.begins[b + 1] - self.tree.begins[b]
        at = np.repeat(self.tree.begins[b], copies) + np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
        a, score, ids = np.repeat(a, copies), np.repeat(score, copies), self.tree.ids[at]
        other = ids != self.own[a]
        self.add(a[other], ids[other], score[other])

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(q):
            return
        touched = np.unique(q)
        q = np.r_[np.repeat(touched, self.k), q]
        ids, score = np.r_[self.ids[touched].ravel(), ids], np.r_[self.score[touched].ravel(), score]
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        fresh = np.r_[True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]) | (score[1:] != score[:-1])] | (score == -np.inf)
        q, ids, score = q[fresh], ids[fresh], score[fresh]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.ids[q[keep], rank[keep]], self.score[q[keep], rank[keep]] = ids[keep], score[keep]

    def descend(self, number: int, q: np.ndarray) -> None:
        """To each query's own leaf, for a first bound."""
        vantage, inside, outside, begin, end = self.tree.nodes[number]
        if vantage < 0:
            self.look(q, begin, end)
            return
        near = chords_to(self.units[q], self.tree_units[vantage]) <= self.tree.bounds[number][1]
        for child, some in ((inside, q[near]), (outside, q[~near])):
            if len(some):
                self.descend(child, some)

    def visit(self, number: int, q: np.ndarray) -> None:
        """Through the tree; a side is left out if its distances to the vantage point put it beyond reach."""
        vantage, inside, outside, begin, end = self.tree.nodes[number]
        if vantage < 0:
            self.look(q, begin, end)
            return
        self.look(q, vantage, vantage + 1)
        d, bounds = chords_to(self.units[q], self.tree_units[vantage]), self.tree.bounds[number]
        for child, low, high in ((inside, *bounds[:2]), (outside, *bounds[2:])):
            some = np.maximum(d - high, low - d) <= self.reach(q)
            if some.any():
                self.visit(child, q[some])


@dataclass
class Index:
    """Shards (cell, sub and the columns of Tree) with what the driver knows of the cells: at most CELLS entries each."""

    shards: DataFrame
    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    subs: list[int]
    components: int
    copies: int


def nearest_cells(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """vec_id, v, cell and the distance to the cell's pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, text=""):
            x = matrix(piece.column(1))
            units = unit(x)
            cell = np.argmax(units @ pivots.T, axis=1)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(cell, pa.int32()), pa.array(np.linalg.norm(units - pivots[cell], axis=1))], ["vec_id", "v", "cell", "d"])

    return rows.mapInArrow(tidy(run), f"vec_id long, v {rows.schema['v'].dataType.simpleString()}, cell int, d double")


def by_cell(values: list[int]) -> Column:
    """The entry of a row's cell."""
    return F.get(F.array(*(F.lit(int(v)) for v in values)), F.col("cell"))


def shard_of(subs: list[int]) -> Column:
    """Where among the shards of its cell a row lies."""
    return F.pmod(F.xxhash64("vec_id", "v"), by_cell(subs)).cast("int")


def make_index(rows: DataFrame, vector: str = "embedding", components: int = 64, k: int = 5, shard: int = SHARD) -> tuple[Index, DataFrame]:
    """The index of all rows for searches of up to ``k`` neighbours, and the rows with their cells.

    Cells lie around vectors of a sample: as many as there are shards, CELLS at most, those with the least hash of id. Every row is filed under the
    nearest; a cell of more than ``shard`` rows is dealt into shards by hash, so a place where a third of all vectors lies is many shards.
    """
    vectors = vectors_of(rows, vector, components)
    wanted = min(CELLS, -(-vectors.count() // shard))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(wanted).collect() if wanted else []
    pivots = np.array([r["v"] for r in sample], np.float64).reshape(-1, components)
    pivots = np.unique(unit(pivots), axis=0)
    placed = written(nearest_cells(vectors, pivots), "placed")
    found = {r["cell"]: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).collect()}
    subs = [-(-found[c]["n"] // shard) if c in found else 0 for c in range(len(pivots))]
    low, high = (np.array([found[c][name] if c in found else np.inf for c in range(len(pivots))]) for name in ("low", "high"))
    copies = k + 1  # a query may be one of them

    def grown(key: tuple, group: pa.Table) -> pa.Table:
        x = matrix(group.column("v").combine_chunks())
        parts = build(group.column("vec_id").to_numpy(), x, copies).packed()
        return pa.table({"cell": pa.array([key[0].as_py()], pa.int32()), "sub": pa.array([key[1].as_py()], pa.int32())} | {c.split()[0]: pa.array([p], pa.binary()) for c, p in zip(Tree.COLUMNS.split(", "), parts)})

    shards = placed.select("vec_id", "v", "cell", shard_of(subs).alias("sub")).groupBy("cell", "sub").applyInArrow(grown, f"cell int, sub int, {Tree.COLUMNS}") if subs else rows.sparkSession.createDataFrame([], f"cell int, sub int, {Tree.COLUMNS}")
    return Index(written(shards, "shards"), pivots, low, high, subs, components, copies), placed


ASKED = "query_id long, v array<double>, home int, home_sub int, known double"
ANSWER = "query_id long, v array<double>, home int, home_sub int, known double, ids array<long>, scores array<double>, compared long"


def answered(index: Index, asked: DataFrame, salts: list[int], k: int, factor: float) -> DataFrame:
    """ANSWER for rows of ASKED with a cell and a sub: what that shard has for the query.

    Shards and queries meet in one sorted stream: a shard comes first, then its queries in batches, so that a task holds one shard and one
    batch. A shard that more than ANSWERED queries want is copied, and the queries are dealt to its copies.
    """
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (c.split(" ", 1) for c in ASKED.split(", "))]
    tree = [c.split()[0] for c in Tree.COLUMNS.split(", ")]
    count = F.greatest(F.lit(1), by_cell(salts))
    shards = index.shards.select("cell", "sub", F.explode(F.sequence(F.lit(0), count - 1)).alias("salt"), F.lit(0).alias("kind"), *tree, *empty)
    queries = asked.select("cell", "sub", F.pmod(F.xxhash64("query_id", "v"), count).cast("int").alias("salt"), F.lit(1).alias("kind"), *(F.lit(None).cast("binary").alias(c) for c in tree), *(c.split()[0] for c in ASKED.split(", ")))
    stream = shards.unionByName(queries).repartition("cell", "sub", "salt").sortWithinPartitions("cell", "sub", "salt", "kind")
    components = index.components
    names = [c.split()[0] for c in ANSWER.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, here = None, None

        def answer(piece: pa.RecordBatch) -> pa.RecordBatch:
            x = matrix(piece.column("v"))
            own, known = piece.column("query_id").to_numpy(), piece.column("known").to_numpy()
            found = Answers(held, own, x, known, k, factor)
            full = found.score > -np.inf
            offsets = np.r_[0, np.cumsum(full.sum(1))].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[full])) for values in (found.ids, found.score)]
            return pa.RecordBatch.from_arrays([*(piece.column(n) for n in names[:5]), *lists, pa.array(found.compared)], names)

        for batch in batches:
            keys = np.stack([batch.column(n).to_numpy() for n in ("cell", "sub", "salt")], 1)
            kinds = batch.column("kind").to_numpy()
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1) | (kinds[1:] == 0) | (kinds[:-1] == 0)])
            for begin, end in zip(cuts, [*cuts[1:], len(kinds)]):
                if kinds[begin] == 0:
                    held, here = Tree.unpacked([batch.column(c)[begin].as_py() for c in tree], components), tuple(keys[begin])
                    begin += 1
                if begin < end:
                    assert here == tuple(keys[begin]), "a query without its shard"
                    for at in range(begin, end, BATCH):
                        yield answer(batch.slice(at, min(BATCH, end - at)))

    return stream.mapInArrow(tidy(run), ANSWER)


def further_cells(first: DataFrame, index: Index, k: int, factor: float) -> DataFrame:
    """ASKED with the cells in whose range of distances a better neighbour may lie."""
    pivots, low, high = index.pivots, index.low, index.high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, text="", limit=1 << 20):
            x = matrix(piece.column("v"))
            units = unit(x)
            known = np.array([s[k - 1] if len(s) >= k else -2.0 for s in piece.column("scores").to_pylist()])
            reach = np.where(known < -1, np.inf, factor * chord(known)) + EPSILON
            d = chord(units @ pivots.T)
            q, cell = np.nonzero((np.maximum(d - high, low - d) <= reach[:, None]) & np.isfinite(low))
            rows = piece.select(["query_id", "v", "home", "home_sub"]).take(pa.array(q))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(known[q]), pa.array(cell, pa.int32())], ["query_id", "v", "home", "home_sub", "known", "cell"])

    return first.select("query_id", "v", "home", "home_sub", "scores").mapInArrow(tidy(run), f"{ASKED}, cell int")


def search(index: Index, queries: DataFrame, k: int = 5, factor: float = 1.0) -> DataFrame:
    """ANSWER of every shard that was asked: among them the ``k`` rows of the index nearest to each query, but for those with its own id.

    ``queries``: vec_id, v and cell as ``nearest_cells`` gives them. Each query asks a shard of its own cell first; the cosine of its
    k-th find then says which other cells, and which sides of which vantage points there, can hold a better one. By the triangle inequality
    nothing else can; ``factor`` below 1 takes that reach shorter and so leaves out more, and 1 is exact. ``compared``: points of the shard that the
    query was compared with.
    """
    if not 0 < factor <= 1:
        raise ValueError("factor must be above 0 and at most 1")
    if k >= index.copies:
        raise ValueError(f"the index was made for up to {index.copies - 1} neighbours")
    once = queries.select("vec_id", "v", "cell").dropDuplicates(["vec_id", "v"])
    at_home = once.select(F.col("vec_id").alias("query_id"), F.col("v").cast("array<double>").alias("v"), F.col("cell").alias("home"), shard_of(index.subs).alias("home_sub"), F.lit(-2.0).alias("known"), "cell", shard_of(index.subs).alias("sub"))
    # the queries of a cell are dealt over its shards at home, so a copy takes a few more than its share at most
    asking = {r["cell"]: r["count"] for r in at_home.groupBy("cell").count().collect()}
    first = written(answered(index, at_home, [-(-asking.get(c, 0) // (ANSWERED * max(1, s))) for c, s in enumerate(index.subs)], k, factor), "home")
    beyond = further_cells(first, index, k, factor).withColumn("sub", F.explode(F.sequence(F.lit(0), by_cell(index.subs) - 1))).filter("cell <> home or sub <> home_sub")
    asking = {r["cell"]: r["count"] for r in beyond.filter("sub = 0").groupBy("cell").count().collect()}
    second = written(answered(index, beyond, [-(-asking.get(c, 0) // ANSWERED) for c in range(len(index.subs))], k, factor), "further")
    return first.unionByName(second)


def ranked(answers: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the best ``k`` of what the shards answered to each query."""
    found = answers.select("query_id", F.xxhash64("v").alias("q"), F.explode(F.arrays_zip("ids", "scores")).alias("f"))
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("f.scores"), "f.ids"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("f.ids").alias("vec_id"), F.col("f.scores").alias("score"))


def nearest(rows: DataFrame, vector: str = "embedding", components: int = 64, every: int = 50, k: int = 5, factor: float = 1.0, shard: int = SHARD) -> DataFrame:
    """``search`` and ``ranked`` for the rows whose id is divisible by ``every``, among all rows.

    Rows with a null id, and vectors that are null, zero, of another length, or hold null or non-finite components take no part. Ties in
    cosine go to the smaller id. Rows equal in id and vector count once; several vectors under one id are rows, and queries, of their
    own, to which none of that id is an answer. With fewer than ``k`` other rows, all are given; an empty table gives no rows; further
    columns aren't read.
    """
    index, placed = make_index(rows, vector, components, k, shard)
    if not index.subs:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return ranked(search(index, placed.filter(F.col("vec_id") % every == 0), k, factor), k)
