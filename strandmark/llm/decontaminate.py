"""Benchmark decontamination by Wu-Manber multi-pattern search over words (operator 6)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from strandmark.llm.frames import map_rows, slices, tidy, written

#: A-Z become a-z; other ASCII characters but digits and letters separate words; bytes of non-ASCII characters stay.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


class WuManber:
    """All patterns of one length ``m`` (in words): shift table by blocks of words, then buckets by hash of the suffix.

    A block is ``b`` words (3, fewer for shorter patterns). ``shift`` says how far the window may move on when it ends
    with that block; absent blocks allow ``m - b + 1``. At shift 0 the bucket of the window's last block lists the
    patterns to compare directly.
    """

    def __init__(self, patterns: Iterable[tuple[int, tuple[bytes, ...]]], m: int):
        self.m, self.b = m, min(3, m)
        self.shift: dict[bytes, int] = {}
        self.bucket: dict[bytes, dict[bytes, list[int]]] = {}
        for number, pattern in patterns:
            for end in range(self.b, m + 1):
                block = b" ".join(pattern[end - self.b : end])
                self.shift[block] = min(self.shift.get(block, m), m - end)
            self.bucket.setdefault(block, {}).setdefault(b" ".join(pattern), []).append(number)

    def search(self, text: list[bytes]):
        """(position, items) of every occurrence."""
        m, b, shift, far, n = self.m, self.b, self.shift, self.m - self.b + 1, len(text)
        get, join = shift.get, b" ".join
        end = m
        while end <= n:
            block = join(text[end - b : end])
            step = get(block, far)
            if step:
                end += step
                continue
            items = self.bucket[block].get(join(text[end - m : end]))
            if items:
                yield end - m, items
            end += 1


def compile_items(items: list[tuple[str, str | None]], window: int) -> list[WuManber]:
    """A matcher for windows, and one for each length of the items that are shorter than a window."""
    by_length: dict[int, list] = {}
    for number, (_, text) in enumerate(items):
        w = tuple(words(text))
        m = min(window, len(w))
        if m:
            by_length.setdefault(m, []).extend((number, p) for p in {w[i : i + m] for i in range(len(w) - m + 1)})
    return [WuManber(p, m) for m, p in sorted(by_length.items())]


def blocks_of(benchmark: DataFrame, max_bytes: int):
    """Benchmark items in lists of at most ``max_bytes`` of text; an item longer than that is a list of its own."""
    part, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        n = len(r["text"] or "")
        if part and size + n > max_bytes:
            yield part
            part, size = [], 0
        part.append((r["item_id"], r["text"]))
        size += n
    if part:
        yield part


def with_last(parts: Iterable[list]) -> Iterator[tuple[list, bool]]:
    """Each part, and whether it is the last; an empty one if there are none. Two parts are held at a time."""
    held = None
    for part in parts:
        if held is not None:
            yield held, False
        held = part
    yield held or [], True


def covered_words(spans: list[int]) -> int:
    """Words under at least one of the spans, given as start, end, start, end, ..."""
    hit = reach = 0
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        hit += max(0, b - max(a, reach))
        reach = max(reach, b)
    return hit


def is_contaminated(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


class Search:
    """The matchers of one part of the benchmark."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.names = ["null" if i is None else i for i, _ in items]
        self.matchers = compile_items(items, window)

    def __call__(self, text: list[bytes]) -> tuple[list[int], set[str]]:
        spans, found = [], set()
        for matcher in self.matchers:
            for at, numbers in matcher.search(text):
                found.update(numbers)
                spans += (at, at + matcher.m)
        return spans, {self.names[k] for k in found}


def find_items(docs: DataFrame, benchmark: DataFrame, window: int = 13, max_bytes: int = 32 << 20) -> DataFrame:
    """Per row: n_words, words hit by benchmark windows, items found, and whether a twentieth of the words is hit.

    A window is ``window`` consecutive words of an item; an item with fewer words is one window. Null and empty texts
    have no words and aren't contaminated; null item ids count as the string "null"; repeated items count once by id;
    an empty benchmark marks nothing; repeated rows stay rows; other columns aren't read.
    Texts aren't shuffled: the matcher is broadcast. Its size is bounded: a benchmark of over ``max_bytes`` characters is
    searched part after part, each pass writing its spans and items for the next, so that one part's matcher is held at a time.
    """
    context = docs.sparkSession.sparkContext
    df = docs.select("doc_id", "text", F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for part, last in with_last(blocks_of(benchmark, max_bytes)):
        shared = context.broadcast(part)

        def make(shared=shared, last=last):
            search = Search(shared.value, window)

            def work(rows: dict) -> dict:
                split = [*map(words, rows["text"])]
                found = [search(w) for w in split]
                spans = [a + b for a, (b, _) in zip(rows["spans"], found)]
                items = [sorted({*a, *b}) for a, (_, b) in zip(rows["items"], found)]
                if not last:
                    return rows | {"spans": spans, "items": items}
                n, hit = [*map(len, split)], [*map(covered_words, spans)]
                digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
                return {"doc_id": rows["doc_id"], "n_words": n, "n_hit": hit, "n_items": [*map(len, items)], "items_sha256": digests, "contaminated": [*map(is_contaminated, hit, n)]}

            return work

        df = map_rows(df, make, RESULT if last else "doc_id long, text string, spans array<long>, items array<string>")
        if not last:
            df = written(df, "searched")
            shared.unpersist()
    return df


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, max_bytes: int = 32 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, without the contaminated ones.

    Verdict and filter are narrow passes: the text itself is judged, so repeated or null ids do no harm. A benchmark over
    ``max_bytes`` is searched part after part; rows are written whole with the spans found so far for the next, and the last pass judges.
    Null and empty texts stay; repeated rows are judged alike; a share of exactly a twentieth is contaminated; an empty benchmark or
    table changes nothing; columns of any name come through as they are. A very long text is held by its own task alone.
    """
    context = docs.sparkSession.sparkContext
    row = StructType([StructField(f.name, f.dataType) for f in docs.schema.fields])
    carried = StructType([StructField("row", row), StructField("spans", ArrayType(LongType()))])
    df = docs.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias("row"), F.array().cast("array<long>").alias("spans"))
    for part, last in with_last(blocks_of(benchmark, max_bytes)):
        shared = context.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last) -> Iterator[pa.RecordBatch]:
            search = Search(shared.value, window)
            for piece in slices(batches):
                rows = piece.column(0)
                split = [*map(words, rows.field("text").to_pylist())]
                spans = [a + search(w)[0] for a, w in zip(piece.column(1).to_pylist(), split)]
                if last:
                    keep = [not is_contaminated(covered_words(s), len(w)) for s, w in zip(spans, split)]
                    yield pa.RecordBatch.from_struct_array(rows).filter(pa.array(keep, pa.bool_()))
                else:
                    yield pa.RecordBatch.from_arrays([rows, pa.array(spans, pa.list_(pa.int64()))], ["row", "spans"])

        df = df.mapInArrow(tidy(run), docs.schema if last else carried)
        if not last:
            df = written(df, "searched")
            shared.unpersist()
    return df
