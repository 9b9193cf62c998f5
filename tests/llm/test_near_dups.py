"""Operator 8 against brute force over all pairs."""

import random
from collections import Counter

import numpy as np

from strandmark.llm import near_dups
from strandmark.llm.frames import table


def brute(rows, least=0.8):
    """doc_id -> (class, exact-copy class), by all pairs of texts."""
    sets, first = {}, {}
    for d, t in rows:
        if t is not None:
            w = t.split()
            n = min(5, len(w))
            sets[t] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
            if d is not None:
                first[t] = min(d, first.get(t, d))
    root = {t: t for t in sets}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    texts = list(sets)
    for i, a in enumerate(texts):
        for b in texts[:i]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= least * len(x | y):
                root[find(a)] = find(b)
    low = {}
    for t in texts:
        if t in first:
            low[find(t)] = min(first[t], low.get(find(t), first[t]))
    return Counter((d, d, d) if t is None else (d, low.get(find(t)), first.get(t)) for d, t in rows)


def got(df):
    return Counter((r["doc_id"], r["class_id"], r["copy_id"]) for r in near_dups.near_duplicates(df).collect())


def test_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    assert got(docs) == brute(docs.collect())
    left = near_dups.keep_one_of_each(table(spark, sf_dir, "documents"))
    assert {r["doc_id"] for r in left.collect()} == {c for _, c, _ in brute(docs.collect())}


def test_awkward(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = rnd.choices(words, k=200)

    def edited(n):
        w = list(base)
        for _ in range(n):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        return " ".join(w)

    texts = [edited(rnd.choice([1, 2, 3, 5, 7, 9])) for _ in range(60)]
    drift = base
    for _ in range(12):  # each like the one before, the last unlike the first
        drift = drift[4:] + rnd.choices(words, k=4)
        texts.append(" ".join(drift))
    rows = [(i + 10, t) for i, t in enumerate(texts)]
    rows += [(1, None), (2, None), (3, ""), (4, ""), (5, " \n"), (6, "one two"), (7, "one  two"), (8, "one two"), (9, "x " * 30_000), (None, "one two"), (None, "only without an id here now"), (6, "one two")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, cls int")
    assert got(df) == brute(rows)
    assert near_dups.near_duplicates(df.filter("false")).collect() == []


def test_large_buckets(spark, monkeypatch):
    """Blocks find what all pairs would."""
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    base = rnd.choices(words, k=150)
    rows = []
    for i in range(80):
        w = list(base)
        for _ in range(rnd.choice([1, 2, 4, 8])):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)


def test_repeated_lines(spark):
    """Near copies in one of which a line stands 50 times are found like any others."""
    rows = []
    for i in range(20):
        base, line = " ".join(f"w{i}x{k}" for k in range(200)), " ".join(f"l{i}x{k}" for k in range(10))
        rows += [(2 * i, f"{base} {line}"), (2 * i + 1, f"{base} " + f"{line} " * 50)]
    want = brute(rows)
    assert {c for _, c, _ in want} == {*range(0, 40, 2)}
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_estimates_probability_jaccard():
    rnd = np.random.default_rng(5)
    for _ in range(3):
        wa, wb = rnd.integers(0, 4, 60), rnd.integers(0, 4, 60)
        wb[:40] = wa[:40]
        exact = sum(1 / sum(max(wa[e] / wa[d], wb[e] / wb[d]) for e in range(60)) for d in range(60) if wa[d] and wb[d])
        ids = near_dups.mixed(np.arange(60, dtype=np.uint64) + np.uint64(rnd.integers(1 << 40)))
        elements, weights = np.concatenate([ids[wa > 0], ids[wb > 0]]), np.concatenate([wa[wa > 0], wb[wb > 0]]).astype(float)
        doc = np.repeat([0, 1], [(wa > 0).sum(), (wb > 0).sum()])
        s = near_dups.prob_minhash(elements, weights, doc, 2, 4096)
        assert abs((s[0] == s[1]).mean() - exact) < 0.04


def test_odd_column_names_come_through(spark):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(2, text + " more", 1, 2, 3, 4), (1, text, 5, 6, 7, 8)], "doc_id long, text string, `a.b` int, gone_id int, cls int, `class id` int")
    left = near_dups.keep_one_of_each(docs)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(1, text, 5, 6, 7, 8)]
