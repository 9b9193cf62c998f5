"""Filter interaction audit: what each filter removes in each order, from counts by failure mask (operator 12)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import sha256
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmark.llm.frames import slices, tidy, written

#: Capitals of filter C, characters of filter D, and bytes of a text whose words are listed at once.
CAPITALS, MARKS, PIECE = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|", 1 << 20
#: Bytes that begin a character in UTF-8.
STARTS = bytes(x for x in range(256) if x & 0xC0 != 0x80)


def word_counts(text: bytes) -> tuple[int, int]:
    """Words, which ASCII white space separates, and different words; a long text is read in pieces that end with a word."""
    if len(text) <= PIECE:
        words = text.split()
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(text):
        *whole, last = text[at : at + PIECE].split() or [b""]
        end = at + PIECE
        if end < len(text) and not text[end - 1 : end].isspace():  # the last word may go on, however long it is
            rest = text[end : end + PIECE]
            while rest and not rest[:1].isspace():
                more = rest.split(None, 1)[0]
                last, end = last + more, end + len(more)
                rest = text[end : end + PIECE] if len(more) == len(rest) else b""
        words = [*whole, last] if last else whole
        n += len(words)
        seen.update(words)
        at = end
    return n, len(seen)


def text_mask(text: bytes) -> int:
    """Bits 0 to 3: the text fails A, B, C, D."""
    n, distinct = word_counts(text)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text) if text.isascii() else len(text) - len(text.translate(None, STARTS))
    return (n < 200) | (100 * distinct < 50 * n) << 1 | (100 * capitals > 3 * points) << 2 | (len(text.translate(None, MARKS)) < len(text)) << 3


def failure_masks(docs: DataFrame, labels: DataFrame, part: str = "lang", text: str = "text") -> DataFrame:
    """part, mask (bit i: fails the i-th of ABCDE), n, good, toxic: rows of ``docs`` counted by what they fail.

    E is failed by a text that a smaller doc_id has as well. Rows of one text differ in nothing but id, part and labels, so
    after counting the rows of an id, a text is gathered by part and labels: the row with the least id comes out as
    ``min(struct)``, which tasks combine before the shuffle, and no text, however frequent, sends more than a few rows a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            texts = [x or b"" for x in piece.column(2).cast(pa.binary()).to_pylist()]
            columns = [piece.column(0), piece.column(1), pa.array([sha256(x).digest() for x in texts], pa.binary()), pa.array(map(text_mask, texts), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "same", "mask"])

    read = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("text")).mapInArrow(tidy(run), "doc_id long, part string, same binary, mask int")
    rows = written(read.groupBy("doc_id", "part", "same", "mask").agg(F.count("*").alias("n")), "masks")
    known = labels.groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    marked = rows.join(known, "doc_id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    alike = marked.groupBy("same", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), least.alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("same"))  # over parts and labels, not rows
    passing = F.col("no_id") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    both = alike.withColumn("passing", passing).select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("passing").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("passing")).alias("n")))).alias("m"))
    n = F.col("m.n")
    return both.groupBy("part", F.col("m.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def survivors(masks: DataFrame, filters: int, values: list[str]) -> DataFrame:
    """part and, for each of ``values``, an array over all subsets of filters (bit i: filter i): what survives the subset.

    A row survives a subset if it fails none of it, so its mask lies in the complement. Sums over submasks are the subset-zeta
    transform: one addition a bit and element, instead of a sum a subset.
    """
    size = 1 << filters
    held = masks.groupBy("part").agg(*(F.array(*(F.sum(F.when(F.col("mask") == m, F.col(v)).otherwise(0)) for m in range(size))).alias(v) for v in values))
    for i in range(filters):
        bit = 1 << i
        add = lambda v: F.transform(v, lambda x, at: x + F.when(at.bitwiseAND(F.lit(bit)) != 0, F.get(F.col(v), at - bit)).otherwise(0))  # noqa: E731, B023
        held = held.select("part", *(add(v).alias(v) for v in values))
    turned = lambda v: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda s: F.get(F.col(v), F.lit(size - 1) - s))
    return held.select("part", *(turned(v).alias(v) for v in values))


def order_steps(survived: DataFrame, names: str) -> DataFrame:
    """A row for each part, order and step: differences of survivors between a step's subset and the one before it.

    ``survived`` has arrays ``n``, ``good`` and ``toxic`` over the subsets of the filters ``names``, a letter each.
    """
    k, everything = len(names), (1 << len(names)) - 1
    steps = survived.select("*", F.explode(F.array(*(F.lit("".join(p)) for p in permutations(names)))).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    place = F.position(F.substring("filter_order", F.col("step"), F.lit(1)), F.lit(names))
    bit = F.get(F.array(*(F.lit(1 << i) for i in range(k))), place - 1)
    before = reduce(lambda a, b: a + b, (F.when(F.locate(c, "filter_order") < F.col("step"), 1 << i).otherwise(0) for i, c in enumerate(names)))
    steps = steps.withColumns({"bit": bit, "before": before})

    def lost(s: Column, value: str = "n") -> Column:
        """What the step's filter removes from the survivors of subset ``s``."""
        return F.get(value, s) - F.get(value, s + F.col("bit"))

    # in all orders together, a filter stands directly behind a subset of s others s! * (k - 1 - s)! times
    times = F.array(*(F.lit(factorial(s) * factorial(k - 1 - s)) for s in range(k)))
    without = F.filter(F.sequence(F.lit(0), F.lit(everything)), lambda s: s.bitwiseAND(F.col("bit")) == 0)
    shapley = F.aggregate(without, F.lit(0).cast("long"), lambda total, s: total + F.get(times, F.bit_count(s)) * lost(s))
    here = F.col("before")
    return steps.select(
        "part", "filter_order", "step", F.get("n", here + F.col("bit")).alias("kept"), lost(here).alias("removed"), (lost(F.lit(0)) - lost(here)).alias("redundant"),
        lost(F.lit(everything) - F.col("bit")).alias("unique_fails"), lost(here, "good").alias("good_lost"), lost(here, "toxic").alias("toxic_lost"), shapley.alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """Rows of ``order_steps`` for the five filters of ``failure_masks`` over every part of ``docs``.

    Null texts are empty and fail A alone; empty and blank texts likewise, but for E if a smaller id has the same text. Rows with a null
    doc_id never fail E, and no row fails it because of them; of rows with one id and one text all or none fail it. A null part is the
    empty string. Every row counts, repeated ones too; a label counts for all rows of its id, if any of the id's labels has it; labels
    without a document have no effect. An empty table gives no rows. Further columns aren't read. A very long text is one row's work.
    """
    return order_steps(survivors(failure_masks(docs, labels, part), 5, ["n", "good", "toxic"]), "ABCDE")
