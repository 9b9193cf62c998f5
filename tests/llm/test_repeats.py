"""Operators 9 and 10 against brute force."""

import gc
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from strandmark.llm import anchors, frames, substrings, suffixes
from strandmark.llm.frames import table


def brute(docs, symbols, length):
    """(doc_id, symbols, covered positions) of each row."""
    least = {}
    split = [(d, symbols(t)) for d, t in docs]
    for d, s in split:
        if d is not None:
            for i in range(len(s) - length + 1):
                k = tuple(s[i : i + length])
                least[k] = min(d, least.get(k, d))
    for d, s in split:
        gone = set()
        if d is not None:
            for i in range(len(s) - length + 1):
                if least[tuple(s[i : i + length])] < d:
                    gone.update(range(i, i + length))
        yield d, s, gone


def brute_words(docs, length=13):
    for d, s, gone in brute(docs, lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or ""), length):
        kept = " ".join(w for i, w in enumerate(s) if i not in gone)
        yield d, len(s), len(gone), hashlib.sha256(kept.encode()).hexdigest()


def brute_bytes(docs, length=50):
    for d, s, gone in brute(docs, lambda t: (t or "").encode(), length):
        kept = bytes(b for i, b in enumerate(s) if i not in gone)
        yield d, len(s), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest()


@pytest.fixture(scope="module")
def awkward(spark):
    rnd = random.Random(7)
    vocabulary = ["the", "of", "ée", "Zü", "a", "x" * 30]
    text = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    base, other = text(120), text(80)
    rows = [(5, base), (3, base + " " + other), (9, other[10:] + "\n\t" + base[:200]), (4, "a " * 60), (6, "a " * 300), (7, "a" * 500), (8, "a" * 90)]
    rows += [(11, base), (11, base), (11, other), (12, None), (13, ""), (14, "short"), (None, base), (None, None), (2, text(14)), (1, "東京" * 40), (20, "x東京" * 3 + "東京" * 30)]
    rows += [(100 + i, text(40) + " " + base[: 20 + 7 * i]) for i in range(30)]
    rows += [(200 + i, "b " * i) for i in range(11, 16)]
    return spark.createDataFrame([(*r, "en", "s", 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, shard int")


def test_words(spark, sf_dir, awkward):
    for df in (awkward, table(spark, sf_dir, "documents")):
        docs = df.select("doc_id", "text").collect()
        assert Counter(map(tuple, substrings.repeated_spans(df).collect())) == Counter(brute_words(docs))
    left = substrings.remove_repeats(awkward)
    assert left.columns == awkward.columns and left.count() == awkward.count()
    got = Counter((r["doc_id"], hashlib.sha256(" ".join((r["text"] or "").split()).encode()).hexdigest()) for r in left.collect())
    assert got == Counter((d, h) for d, _, _, h in brute_words(awkward.select("doc_id", "text").collect()))
    assert substrings.repeated_spans(awkward.filter("false")).collect() == []


def test_bytes(spark, sf_dir, awkward):
    for df in (awkward, table(spark, sf_dir, "documents")):
        docs = df.select("doc_id", "text").collect()
        assert Counter(map(tuple, suffixes.repeated_bytes(df).collect())) == Counter(brute_bytes(docs))
    assert suffixes.repeated_bytes(awkward.filter("false")).collect() == []


def test_hot_anchors(spark, monkeypatch):
    """A phrase in very many different contexts: its windows are dealt by digest, and the result is the same."""
    monkeypatch.setattr(anchors, "HOT_OWNERS", 50)
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    passages = [" ".join(rnd.choices(words, k=20)) for _ in range(40)]
    phrase = "all of these five words"
    rows = []
    for i in range(8000):
        before, after = (" ".join(rnd.choices(words, k=rnd.randrange(3, 16))) for _ in range(2))
        shared = rnd.choice(passages) if i % 5 == 0 else ""
        rows.append((i, f"{before} {phrase} {after} {shared} {phrase} {after[:40]}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, substrings.repeated_spans(docs).collect())) == Counter(brute_words(rows))
    assert Counter(map(tuple, suffixes.repeated_bytes(docs).collect())) == Counter(brute_bytes(rows))


def test_columns_of_any_name(spark):
    """Columns named like the helpers' own come through, with rows of their own kind."""
    base = " ".join(f"w{i}" for i in range(20))
    names = ["_h", "_g", "k", "g", "row", "bucket", "data", "shard", "kind"]
    rows = [(1, base, 2, *range(9)), (2, f"x {base}", 3, *range(10, 19)), (None, base, None, *range(9)), (2, None, 4, *range(9)), (2, f"x {base}", 3, *range(10, 19))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, " + ", ".join(f"{n} long" for n in names)).select("g", "n_chars", "text", "_h", "doc_id", *(n for n in names if n not in ("g", "_h")))
    left = substrings.remove_repeats(docs)
    assert left.schema == docs.schema
    want = Counter(str((r["doc_id"], "x" if r["doc_id"] == 2 and r["text"] else r["text"], 1 if r["doc_id"] == 2 and r["text"] else r["n_chars"], *(r[n] for n in names))) for r in docs.collect())
    assert Counter(str((r["doc_id"], r["text"], r["n_chars"], *(r[n] for n in names))) for r in left.collect()) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=6, max_size=40), min_size=1, max_size=6), st.integers(0, 3))
def test_resolvers(texts, seed):
    texts = list(dict.fromkeys(texts))
    docs = np.array(random.Random(seed).choices(range(4), k=len(texts)), np.int64)
    least = {}
    for d, t in zip(docs.tolist(), texts):
        for i in range(len(t) - 5):
            least[t[i : i + 6]] = min(d, least.get(t[i : i + 6], d))
    most = docs + 2  # the run's greatest document may be another than its least
    want = {(k, i, least[t[i : i + 6]]) for k, t in enumerate(texts) for i in range(len(t) - 5) if least[t[i : i + 6]] < most[k]}
    same = np.zeros(len(texts), np.uint32)
    spaced, plain = [" ".join(t).encode() for t in texts], [t.encode() for t in texts]
    for resolver, data in ((substrings.AutomatonResolver(6), spaced), (substrings.AutomatonResolver(6, 20), spaced), (suffixes.TransformResolver(6), plain)):
        got = [*zip(*(x.tolist() for x in resolver(data, same, most, docs)))]
        assert len(got) == len(want) and {*got} == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab", min_size=1, max_size=60), st.integers(1, 20))
def test_common_prefixes(text, bound):
    data = np.frombuffer(text.encode() + b"\xff", np.uint8)
    order = suffixes.bounded_suffix_order(data, max(8, bound))
    got = suffixes.common_prefixes(data[order - 1], bound).tolist()
    s = bytes(data)
    for a, b, n in zip(order, order[1:], got[1:]):
        same = 0
        while max(a, b) + same < len(s) - 1 and s[a + same] == s[b + same]:
            same += 1
        if n < bound or same >= bound:
            assert n == min(bound, same)


def test_sliding_min():
    h = np.array(random.Random(1).choices(range(50), k=200), np.uint64)
    for w in (1, 2, 3, 8, 23):
        assert anchors.sliding_min(h, w).tolist() == [min(h[i : i + w].tolist()) for i in range(201 - w)]


def test_reference_shards(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "x a b c y"), (3, None), (4, "")], "doc_id long, text string")
    reference = spark.createDataFrame([(1, "z a b c d"), (2, "e f g"), (3, None)], "id long, text string")
    for size in (1 << 20, 4):
        got = dict(map(tuple, substrings.remove_known(docs, reference, 3, size).collect()))
        assert got == {1: "h", 2: "x y", 3: None, 4: ""}


def test_no_bucket_grows_with_the_owners_of_an_anchor(spark):
    """Rows that all have one passage, and words of their own: what a bucket gets follows groups and tasks, not rows."""
    passage = " ".join(f"p{i}" for i in range(13))

    def fullest(n):
        docs = anchors.keyed(spark.range(0, n, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit(passage + " own"), F.col("id").cast("string")).alias("text")), 256)
        found = anchors.find_anchors(docs, anchors.Words(13, 5), 4096, 256)
        sizes = found.filter("g < 0").groupBy("bucket").agg(F.sum(F.octet_length("data")).alias("n"))
        return sizes.agg(F.max("n"), F.median("n")).first()

    (few, _), (many, _) = fullest(5000), fullest(20_000)
    assert many < 2 * few, (few, many)


def test_hashes_of_bytes_are_those_of_each_string_alone():
    units, rnd = anchors.Bytes(50, 24), random.Random(5)
    for size in (0, 7, 8, 23, 24, 25, 31, 200):
        data = bytes(rnd.choices(b"ab \xc3\xa4", k=size))
        ends, hashes, cut = units.load([data[: size // 3], data[size // 3 :]])
        assert hashes.tolist() == [int(units.load([data[i : i + 24]])[1][0]) for i in range(size - 23)] and ends.tolist() == [size // 3, size]


def test_groups_run_without_the_collector_of_cycles():
    seen = []
    frames.tidy_group(lambda rows: seen.append(gc.isenabled()))(None)
    with pytest.raises(ZeroDivisionError):
        frames.tidy_pair(lambda left, right: 1 // 0)(None, None)
    assert seen == [False] and gc.isenabled()
