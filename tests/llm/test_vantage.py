"""Vantage-point trees against all cosines."""

import math
import random

import numpy as np
import pytest

from strandmark.llm import vantage


def takes_part(i, v, n):
    return i is not None and v is not None and len(v) == n and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute(rows, n, every, k):
    kept = sorted({(i, tuple(v)) for i, v in rows if takes_part(i, v, n)})
    ids, x = np.array([i for i, _ in kept]), np.array([v for _, v in kept], float).reshape(-1, n)
    norms, out = vantage.squares(x), []
    for q in range(len(ids)):
        if ids[q] % every == 0:
            score = vantage.cosines(x, np.repeat(x[q : q + 1], len(x), 0), norms, np.repeat(norms[q], len(x)))
            best = sorted((-s, i) for s, i in zip(score, ids) if i != ids[q])[:k]
            out += [(int(ids[q]), r, int(i), -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def found(spark, rows, n, every, k, factor=1.0, shard=40, kind="float"):
    df = vantage.nearest(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3), components=n, every=every, k=k, factor=factor, shard=shard)
    return sorted(map(tuple, df.collect()))


def table(seed, n=6, size=700):
    rng = np.random.default_rng(seed)
    hubs = rng.normal(size=(12, n))
    return [(i, np.float32(hubs[i % 12] + 0.3 * rng.normal(size=n)).tolist()) for i in range(size)]


def test_exact(spark):
    rows = table(11)
    rows += [(1000 + i, [1.0, 0.0, 0.0, 0.0, 0.0, 0.5]) for i in range(300)]  # a third of all in one place
    rows += [(2000 + i, [2.0 * (i + 1), 0.0, 0.0, 0.0, 0.0, 1.0 * (i + 1)]) for i in range(10)]  # the same direction
    rows += [(3000, [-1.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (3010, [0.0, 0.0, 1.0, 0.0, 0.0, 0.0]), (3010, [0.0, 0.0, 1.0, 0.0, 0.0, 0.0]), (3010, [0.0, 1.0, 0.0, 0.0, 0.0, 0.0])]
    odd = [None, [], [0.0] * 6, [1.0] * 5, [1.0, None, 0.0, 0.0, 0.0, 0.0], [math.nan] + [1.0] * 5, [math.inf] + [1.0] * 5]
    rows += [(4000 + 10 * i, v) for i, v in enumerate(odd)] + [(None, [1.0, 0.0, 0.0, 0.0, 0.0, 0.5])]
    assert found(spark, rows, 6, 10, 5) == brute(rows, 6, 10, 5)


def test_copies_of_shards(spark, monkeypatch):
    monkeypatch.setattr(vantage, "ANSWERED", 3)
    rows = table(5, size=300)
    assert found(spark, rows, 6, 2, 3, shard=50) == brute(rows, 6, 2, 3)


def test_few_rows(spark):
    rows = [(10, [1.0, 0.0]), (11, [0.0, -2.0]), (20, [1.0, 1.0])]
    assert found(spark, rows, 2, 10, 5, kind="double") == brute(rows, 2, 10, 5)
    assert found(spark, [], 2, 10, 5) == [] and found(spark, [(10, [1.0, 0.0])], 2, 10, 5) == [] and found(spark, [(10, None)], 2, 10, 5) == []
    odd = spark.createDataFrame([(10, [1.0, 0.0], 1, 2), (3, [1.0, 1.0], 1, 2)], "vec_id long, embedding array<double>, v int, `cell.d` int")
    assert vantage.nearest(odd, components=2, every=10).collect()[0][:3] == (10, 1, 3)


def test_a_shorter_reach_compares_less():
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(60, 4))[rng.integers(0, 60, 4000)] + 0.1 * rng.normal(size=(4000, 4))).astype(np.float32).astype(float)
    tree = vantage.build(np.arange(4000), x, 6)
    assert sorted(tree.ids.tolist()) == list(range(4000))
    tree = vantage.Tree.unpacked(tree.packed(), 4)
    q, taken, recall = np.arange(0, 4000, 40), [], []
    best = [set(np.argsort(-vantage.cosines(x, np.repeat(x[i : i + 1], 4000, 0), vantage.squares(x), np.repeat(vantage.squares(x[i : i + 1]), 4000)))[:6].tolist()) - {i} for i in q]
    for factor in (1.0, 0.7, 0.3):
        got = vantage.Answers(tree, q, x[q], np.full(len(q), -2.0), 5, factor)
        taken.append(got.compared.mean())
        recall.append(np.mean([len(b & set(r)) / len(b) for b, r in zip(best, got.ids.tolist())]))
    assert recall[0] == 1 and recall[0] >= recall[1] >= recall[2] > 0.5
    assert 2000 > taken[0] > taken[1] > taken[2]


def test_trees_of_odd_shards():
    rnd = random.Random(4)
    for points in ([[1.0, 0.0]] * 500, [[math.cos(t), math.sin(t)] for t in range(500)], np.eye(90).tolist(), [[float(rnd.randrange(3)), 1.0] for _ in range(300)]):
        x = np.array(points)
        tree = vantage.build(np.arange(len(x)), x, 3)
        got = vantage.Answers(tree, np.array([-1]), x[:1], np.array([-2.0]), 2, 1.0)
        assert got.ids[0].tolist() == [0, 1] if len(x[0]) > 2 or (x[1] == x[0]).all() else got.ids[0][0] == 0


def test_refusals(spark):
    index, placed = vantage.make_index(spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>"), components=1, k=2)
    for k, factor in ((3, 1.0), (2, 0.0), (2, 1.5)):
        with pytest.raises(ValueError):
            vantage.search(index, placed, k, factor)
