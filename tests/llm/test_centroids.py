"""Exponion clustering against scanning every centroid in every round."""

import math
import random
from hashlib import sha256

import numpy as np
import pytest

from strandmark.llm import centroids


def brute(rows, clusters, rounds, components, scale):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: ((0, sha256(f"3:{r[0]}".encode()).hexdigest()) if r[0] is not None else (1, ""), r[1])
    means = [v for _, v in sorted(kept, key=key)[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(means))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for j in range(len(means)):
            if own := [v for (_, v), k in zip(kept, of) if k == j]:
                means[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *nearest(v)) for i, v in kept]
    every = [sum(d for _, d, k in found if k == j) for j in range(len(means))]
    return sorted(((i, k, d, every[k], sum(every), sha256(",".join(map(str, means[k])).encode()).hexdigest()) for i, d, k in found), key=str)


def found(spark, rows, clusters, rounds, components, scale, kind="float"):
    df = centroids.cluster(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3), clusters=clusters, rounds=rounds, components=components, scale=scale)
    return sorted(map(tuple, df.drop("n_distances").collect()), key=str)


@pytest.mark.parametrize(("clusters", "rounds", "spread"), [(8, 10, 3), (13, 6, 40), (1, 3, 5), (5, 4, 1)])
def test_clusters(spark, clusters, rounds, spread):
    rnd = random.Random(clusters)
    rows = [(i, [float(rnd.randrange(-spread, spread) + 7 * (i % 4)), float(rnd.randrange(-spread, spread)), 0.5 * rnd.randrange(3)]) for i in range(150)]
    rows += [(1000, [1.0, 2.0, 0.0])] * 3 + [(2000 + i, [4.0, 4.0, 0.5]) for i in range(90)]
    rows += [(None, [1.0, 1.0, 1.0]), (None, [2.0, 1.0, 1.0]), (1, None), (2, []), (3, [1.0, None, 2.0]), (4, [1.0, math.nan, 2.0]), (5, [1.0, -math.inf, 2.0]), (6, [1.0, 2.0]), (7, [1.0] * 4)]
    assert found(spark, rows, clusters, rounds, 3, 2) == brute(rows, clusters, rounds, 3, 2)


def test_few_and_no_vectors(spark):
    few = [(None, [3.0, 1.0]), (4, [1.0, 1.0]), (4, [1.0, 1.0]), (9, [-1.5, 0.25])]
    assert found(spark, few, 8, 2, 2, 4, "double") == brute(few, 8, 2, 2, 4)
    assert found(spark, [], 8, 2, 2, 4) == [] and found(spark, [(1, [0.0])], 8, 2, 2, 4) == []
    with pytest.raises(Exception, match="exceeds"):
        found(spark, [(1, [1e30, 0.0])], 8, 1, 2, 4)
    odd = spark.createDataFrame([(1, [0.5, -0.5], 7, 8)], "vec_id long, embedding array<float>, cluster int, `a.b` int")
    assert centroids.cluster(odd, components=2, rounds=1).first()["distance"] == 0


def test_bounds_hold_and_save_distances():
    rng = np.random.default_rng(13)
    hubs = rng.integers(-4000, 4000, (40, 8))
    x = hubs[rng.integers(0, 40, 3000)] + rng.integers(-60, 60, (3000, 8))
    means = x[:40].copy()
    means[7] = means[3]  # equal centroids: the smaller number
    search = centroids.Search(means, None)
    cluster, upper, lower = search.first(x)
    taken = 0
    for _ in range(6):
        new = np.array([x[cluster == j].sum(0) // max(1, (cluster == j).sum()) if (cluster == j).any() else means[j] for j in range(40)])
        search, means = centroids.Search(new, means), new
        cluster, upper, lower, n = search.again(x, cluster, upper, lower)
        taken += n
        every = np.array([centroids.squared(x, c) for c in means])
        assert (cluster == every.argmin(0)).all()  # argmin: the first of equals
        own = np.sqrt(np.take_along_axis(every, cluster[None].astype(int), 0)[0])
        np.put_along_axis(every, cluster[None].astype(int), np.iinfo(np.int64).max, 0)
        assert (upper >= own).all() and (lower <= np.sqrt(every.min(0))).all()
    assert taken < 6 * 3000 * 40 / 5
