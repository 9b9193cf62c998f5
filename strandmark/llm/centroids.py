"""Centroid clustering with exact integers: Exponion search with bounds that outlive a round (operator 13)."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmark.llm.frames import removed, slices, tidy, written_to

#: Components beyond this would make squared distances of 64 of them leave 64 bits.
MOST = 1 << 26
#: Bounds are kept apart from true distances by this share, far above what rounding can do to them.
SLACK = 1e-9
#: Bytes of vectors handled at once in a task.
PIECE = 1 << 20


def whole_vectors(rows: DataFrame, vector: str, components: int, scale: int) -> DataFrame:
    """vec_id and v: floor(scale * x) of each component, for vectors of this many components, none null or non-finite."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(x, lambda c: F.floor(scale * c.cast("double")))
    fits = F.when(F.forall(scaled, lambda c: F.abs(c) <= MOST), scaled).otherwise(F.raise_error(F.lit(f"a component exceeds {MOST} after scaling")))
    return rows.filter((F.size(x) == components) & finite).select("vec_id", fits.cast("array<int>").alias("v"))


def seeds(vectors: DataFrame, clusters: int, salt: str) -> np.ndarray:
    """The vectors whose ids have the least hashes, in that order: ``clusters`` rows at most come to the driver."""
    key = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    return np.array([r["v"] for r in vectors.orderBy(F.asc_nulls_last(key), "v").limit(clusters).collect()], np.int64)


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    d = x - centroid
    return np.einsum("ij,ij->i", d, d)


class Search:
    """Centroids of a round with the lists that the search goes by."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None):
        k = len(centroids)
        self.centroids = centroids
        between = np.sqrt(np.array([squared(centroids, c) for c in centroids], float).reshape(k, k))
        self.order = np.argsort(between, axis=1, kind="stable")  # of each centroid, the others by distance; copies of it come first too
        self.sorted = np.take_along_axis(between, self.order, 1)
        apart = between.copy()
        np.fill_diagonal(apart, np.inf)
        self.nearest = apart.min(axis=1) if k > 1 else np.full(k, np.inf)
        moved = np.sqrt(squared(centroids, before).astype(float)) * (1 + SLACK) if before is not None else np.zeros(k)
        self.moved, self.most_moved = moved, np.array([np.delete(moved, j).max(initial=0.0) for j in range(k)])

    def among(self, x: np.ndarray, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the candidates (in ascending order) the nearest, the smaller number on ties; its squared distance and the second's."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        second, which = best.copy(), np.zeros(len(x), np.int32)
        for j in candidates:
            d = squared(x, self.centroids[j])
            closer = d < best
            second = np.where(closer, best, np.minimum(second, d))
            best, which = np.where(closer, d, best), np.where(closer, j, which)
        return which, best, second

    def first(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """cluster, upper and lower bound by a full scan."""
        return self.bounded(*self.among(x, np.arange(len(self.centroids))))

    def bounded(self, which: np.ndarray, best: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = second == np.iinfo(np.int64).max
        return which.astype(np.int32), np.sqrt(best.astype(float)) * (1 + SLACK), np.where(none, np.inf, np.sqrt(second.astype(float)) * (1 - SLACK))

    def again(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The same after the centroids moved, and the number of distances that it took.

        A vector surely stays if its upper bound is below the lower bound of all other centroids, or below half the way to the
        nearest of them; equality doesn't suffice, since a tie goes to the smaller number. Any other vector looks only into the ball
        around its centroid with radius 2 * upper + the way to the nearest other centroid, which holds its nearest and second
        nearest centroid; the ball's edge belongs to it. The list of distances is read in doubling lengths.
        """
        cluster, upper, lower = cluster.copy(), upper + self.moved[cluster], lower - self.most_moved[cluster]
        safe = np.maximum(lower, self.nearest[cluster] / 2 * (1 - SLACK))
        open_ = np.flatnonzero(upper >= safe)
        upper[open_] = np.sqrt(np.einsum("ij,ij->i", d := x[open_] - self.centroids[cluster[open_]], d).astype(float)) * (1 + SLACK)
        taken, open_ = len(open_), open_[upper[open_] >= safe[open_]]
        for own in np.unique(cluster[open_]):
            rows = open_[cluster[open_] == own]
            radius = (2 * upper[rows] + self.nearest[own]) * (1 + SLACK)
            within = np.searchsorted(self.sorted[own], radius, side="right")
            length = 1 << np.ceil(np.log2(np.maximum(within, 1))).astype(int)
            for n in np.unique(length):
                some = rows[length == n]
                candidates = np.sort(self.order[own, :n])
                cluster[some], upper[some], lower[some] = self.bounded(*self.among(x[some], candidates))
                taken += len(some) * len(candidates)
        return cluster, upper, lower, taken


ROUND = "vec_id long, v array<int>, cluster int, upper double, lower double, distance long, sums array<long>"


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def assigned(vectors: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """Rows of ROUND. ``before``: the centroids of the last round, whose rows ``vectors`` are; without them every centroid is scanned.

    After its vectors a task gives one row more, which has only ``sums``: by how much the vectors that changed their centroid change the sum of
    each centroid's vectors (k * components numbers) and their count (k), then the inertia of each (k), and the distances taken (1).
    """
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(centroids, before)
        change, counts, inertia, taken, any_ = np.zeros((k, width), np.int64), np.zeros(k, np.int64), np.zeros(k, np.int64), 0, False
        for piece in slices(batches, text="", limit=PIECE):
            x, any_ = matrix(piece.column(1), width), True
            if before is None:
                (cluster, upper, lower), moves, n = search.first(x), np.arange(len(x)), len(x) * k
            else:
                old = piece.column(2).to_numpy()
                cluster, upper, lower, n = search.again(x, old, piece.column(3).to_numpy(), piece.column(4).to_numpy())
                moves = np.flatnonzero(cluster != old)
                np.subtract.at(change, old[moves], x[moves])
                np.subtract.at(counts, old[moves], 1)
            np.add.at(change, cluster[moves], x[moves])
            np.add.at(counts, cluster[moves], 1)
            distance = np.einsum("ij,ij->i", d := x - centroids[cluster], d)
            np.add.at(inertia, cluster, distance)
            taken += n
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *map(pa.array, (cluster, upper, lower, distance)), pa.nulls(len(x), pa.list_(pa.int64()))], names)
        if any_:
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.float64(), pa.float64(), pa.int64())]
            sums = [*change.ravel().tolist(), *counts.tolist(), *inertia.tolist(), taken]
            yield pa.RecordBatch.from_arrays([*none, pa.array([sums], pa.list_(pa.int64()))], names)

    names = [f.split()[0] for f in ROUND.split(", ")]
    read = vectors.select("vec_id", "v") if before is None else vectors.select("vec_id", "v", "cluster", "upper", "lower")
    return read.mapInArrow(tidy(run), ROUND)


def summed(rows: DataFrame, n: int) -> np.ndarray:
    """Elementwise sum of the tasks' rows; ``n`` numbers come to the driver. The vectors' own columns aren't read."""
    out = np.zeros(n, np.int64)
    for r in rows.filter("sums is not null").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    return out


def cluster(rows: DataFrame, vector: str = "embedding", clusters: int = 8, rounds: int = 10, components: int = 64, scale: int = 1024, salt: str = "3:") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and n_distances (taken in all rounds, by all vectors).

    Vectors with exactly ``components`` components, none null or non-finite, count, as integers floor(scale * x); the others have no row.
    Centroids start as the vectors whose ``salt`` + id has the least SHA-256; vectors with a null id come last there, and equal ids go by their
    components. Each round assigns every vector to the nearest centroid, the smaller number on ties, and moves each centroid to the
    floor of its vectors' mean; one without vectors stays. All of it is exact. With fewer vectors than ``clusters``, each starts a
    centroid; equal centroids are allowed, the smaller number takes all. Repeated rows are vectors of their own; an empty table gives no rows;
    further columns aren't read. A scaled component beyond 2 ** 26 is an error, as distances would leave 64 bits.

    A round reads the vectors with their bounds and writes them with new ones to the shared store, from where the next goes on; the one before is
    removed then. Only the sums of vectors that changed their centroid come together: a row a task, k * components numbers to the driver.
    """
    spark = rows.sparkSession
    vectors = whole_vectors(rows, vector, components, scale)
    centroids = seeds(vectors, clusters, salt)
    k = len(centroids)
    if not k:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string, n_distances long")
    before, path, taken = None, "", 0
    sums, counts, inertia = np.zeros((k, components), np.int64), np.zeros(k, np.int64), []
    for step in range(rounds + 1):
        last = path
        now, path = written_to(assigned(vectors, centroids, before), f"round{step}")
        if last:
            removed(spark, last)
        change, moved, inertia, n = np.split(summed(now, k * (components + 2) + 1), [k * components, k * (components + 1), k * (components + 2)])
        vectors, before, taken = now.filter("sums is null"), centroids, taken + n[0]
        if step < rounds:
            sums, counts = sums + change.reshape(k, components), counts + moved
            centroids = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], centroids)
    names = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("cluster"))
    total = F.lit(int(inertia.sum())).cast("long")
    return vectors.select("vec_id", "cluster", "distance", of(inertia.tolist()).cast("long").alias("cluster_inertia"), total.alias("inertia"), of(names).alias("centroid_sha256"), F.lit(int(taken)).cast("long").alias("n_distances"))
