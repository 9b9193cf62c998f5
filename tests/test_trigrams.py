"""The trigram index against scanning, and what it reads."""

import random

import numpy as np
from pyspark.sql import functions as F

from strandmark.operators import search, trigrams

WORDS = ["Haus", "haus", "Mühle", "muehle", "café", "ab", "x", "Straße", "und", "Bernstein", "bern", "𝄞𝄞𝄞", "\xa0"]


def test_same_rows_as_scanning(spark, tmp_path):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(8))) for _ in range(200)] + [None, "", "  ", "ab", "abc", "y" * 40 + "nadel" + "z" * 40]
    rows = spark.createDataFrame([(i % 190 if i else None, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    index = trigrams.build_index(rows, "id", "text", str(tmp_path / "index"), shards=5)
    queries = ["haus", "HAUS mühle", "muehle  cafe", "ab", "x ab", "ern", "bern stein", "gibtesnicht", "haus gibtesnicht", "", " \u2003 ", "strasse", "𝄞𝄞𝄞", "nadel", "und x"]
    got = {(r["query"], r["id"]) for r in trigrams.search(index, queries).collect()}
    want = {(i, r["id"]) for i, q in enumerate(queries) for r in rows.filter(search.all_words(F.col("text"), q)).collect()}
    assert got == want
    assert {r["query"] for r in trigrams.search(index, ["ab"]).collect()} == {0}
    assert trigrams.search(index, ["gibtesnicht"]).count() == 0


def test_long_texts_in_pieces(monkeypatch):
    rnd = random.Random(3)
    monkeypatch.setattr(trigrams, "PIECE", 7)
    for _ in range(60):
        text = "".join(rnd.choice("abc𝄞ü") for _ in range(rnd.randrange(40)))
        for n in (1, 2, 3):
            want = {trigrams.gram_code(text[i : i + n]) for i in range(len(text) - n + 1)}
            assert trigrams.codes(text, n).tolist() == sorted(want)


def test_buckets_agree(spark):
    grams = [trigrams.gram_code(x) for x in ("abc", "zz", "a", "\U0010ffff\U0010ffff\U0010ffff", "ü€𝄞", "\0\0\0")]
    df = spark.createDataFrame([(g,) for g in grams], "g long")
    assert [r[0] for r in df.select(trigrams.bucket(F.col("g"))).collect()] == trigrams.bucket(np.array(grams)).tolist()
    assert trigrams.bucket_set(df, "g").sum() == len({*trigrams.bucket(np.array(grams)).tolist()})


def test_many_rows_of_grams(spark, monkeypatch):
    df = spark.createDataFrame([(i, "abcd" * (i % 3), i) for i in range(50)] + [(99, None, 1)], "id int, t string, n int")
    got = trigrams.with_grams(df, "t", [1, 3]).groupBy("id", "n").count().collect()
    assert {(r["id"], r["count"]) for r in got} == {(i, {1: 4 + 2, 2: 4 + 4}[i % 3]) for i in range(50) if i % 3}


def test_only_what_is_needed_is_read(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = trigrams.build_index(docs, "doc_id", "text", str(tmp_path / "index"), shards=16)
    found = trigrams.asked(index, ["steinsch geach"])
    assert len(found.chosen[0]) <= 4 and trigrams.candidates(index, found).count() < docs.count() / 2
    plan = trigrams.candidates(index, found)._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan
    plan = trigrams.search(index, ["steinsch geach"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "shard" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_names_that_share_their_grams_meet_only_texts_that_have_them(spark):
    """Numbers have few trigrams: filed under those, each name met a tenth of all texts."""
    steps = [1, 6]
    names = [f"{7 * i:06d}" for i in range(20_000)]
    filed = trigrams.Filed(steps)
    for t, slot, bit in filed.marks([*names, "x"]).T:
        filed.masks[t, slot] |= np.uint16(bit)
    texts = [f"Customer#{i:09d}" for i in range(2_000)] + ["x", "", "1234", "xx000007"]
    offered = [(o, g) for owners, grams in filed.offered(texts) for o, g in zip(owners, grams)]
    held = {*names, "x"}
    assert {(o, g) for o, g in offered if g in held} == {(i, n) for i, t in enumerate(texts) for n in {t[k : k + 6] for k in range(len(t) - 5)} | {*t} if n in held and n in t}
    assert len(offered) <= 4 * len(texts)


def test_containing_against_every_pair(spark, monkeypatch):
    rnd = random.Random(7)
    monkeypatch.setattr(trigrams, "PIECE", 64)
    trigrams._powers.cache_clear()
    for most in (12, 30):  # few lengths, then more than are filed whole
        names = ["".join(rnd.choice("abü𝄞") for _ in range(rnd.randrange(4, most))) for _ in range(40)]
        texts = ["".join(rnd.choice("abü𝄞c") for _ in range(rnd.randrange(200))) for _ in range(60)]
        texts += [f"c{n}c" for n in names[:20]] + [None, "", "a"]
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(999, "c" + names[0])] * 2, "id int, t string")
        got = sorted(r["id"] for r in search.near_locations(rows, spark.createDataFrame([(n,) for n in [*names, None]], "name string"), "t").collect())
        assert got == sorted([i for i, t in enumerate(texts) if t is not None and any(n in t for n in names)] + [999, 999])
    trigrams._powers.cache_clear()


def test_a_gram_moves_once_a_batch(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["abcabc", "xabc", "ab", None, "bca"] * 20)], "id long, t string").coalesce(1)
    got = trigrams.postings_of(df, "id", "t").collect()
    assert len(got) == 4 and all(r["n"] == len(r["keys"]) for r in got)
    assert {r["gram"]: sorted(r["keys"]) for r in got}[trigrams.gram_code("abc")] == [i for i in range(100) if i % 5 < 2]
