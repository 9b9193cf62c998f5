"""Rows of few files over all cores, and texts that are computed once a row."""

from pyspark.sql import functions as F

from strandmark.functions import text
from strandmark.sources import tables


def test_spread(spark):
    rows = spark.range(0, 1000, 1, 1)
    dealt = tables.spread(rows, 2)
    assert dealt.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism
    assert sorted(r[0] for r in dealt.collect()) == list(range(1000))


def test_pdf_bytes_are_decoded_once(spark):
    df = spark.createDataFrame([(bytearray(b"BT (a \x80) Tj ET"),), (None,), (bytearray(b""),)], "b binary").select(text.pdf_text("b").alias("t"))
    assert [r["t"] for r in df.collect()] == ["a €", None, ""]
    plan = df._jdf.queryExecution().analyzed().toString()
    assert plan.count("decode(b") == 1
