"""Each pipeline stage against brute force on what the stage before kept."""

import corpus_pipeline
from test_maps import brute_items, check_packing
from test_near_dups import brute as brute_classes
from test_repeats import brute_words

from strandmark.llm import decontaminate, near_dups
from strandmark.llm.frames import table, written


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.select("doc_id", "text").collect()
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        kept[name] = (before, dict(docs.select("doc_id", "text").collect()))

    before, after = kept["language_id"]
    assert len(after) >= 0.99 * len(before) and all(dict(before)[d] == t for d, t in after.items())
    before, after = kept["near_dedup"]
    assert after.keys() == {c for _, c, _ in brute_classes(before)}
    before, after = kept["substring_dedup"]
    want = {d: n - gone for d, n, gone, _ in brute_words(before)}
    assert {d: len(t.encode().split()) for d, t in after.items()} == want
    before, after = kept["decontamination"]
    items = [tuple(r) for r in table(spark, sf_dir, "benchmark").collect()]
    texts = [t.split(" ")[0] for _, t in items]
    for d, t in before:
        if d in after or any(x in t for x in texts):
            assert (d in after) is not brute_items(t, items)[-1]

    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    check_packing(packed, list(after.items()))
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r[:5] for r in whole) == sorted(r[:5] for r in packed)


def test_empty(spark, tmp_path, sf_dir):
    for name in ("documents", "benchmark"):
        table(spark, sf_dir, name).filter("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_rows_with_one_id_are_judged_apart(spark):
    """Neither a contaminated row nor a near copy takes other texts of its id along, in however many parts the benchmark comes."""
    item = " ".join(f"b{i}" for i in range(20))
    bench = spark.createDataFrame([(k, item.replace("b", "bcdefg"[k])) for k in range(6)], "item_id long, text string")
    rows = [(1, item, "x"), (1, "clean one", "y"), (None, item.replace("b", "g"), "x"), (None, "clean two", "y"), (2, None, "y"), (1, item.replace("b", "e"), "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `spans` string")
    for most in (1 << 20, 100):
        left = decontaminate.drop_contaminated(docs, bench, max_bytes=most)
        assert left._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1  # one part's matcher at a time
        assert left.schema == docs.schema
        assert sorted(map(str, map(tuple, left.collect()))) == sorted(str(r) for r in rows if r[2] == "y")

    long = " ".join(f"w{i}" for i in range(200))
    texts = [(1, long), (2, long + " end"), (2, "another text"), (2, None), (None, long)]
    left = near_dups.keep_one_of_each(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(map(str, map(tuple, left.collect()))) == sorted(map(str, [texts[0], *texts[2:]]))
