"""Suffix-array dedup by threshold-bounded interval expansion on a Burrows-Wheeler transform (operator 10)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandmark.llm.anchors import Bytes, with_repeats

#: Ends a run; no byte of UTF-8 has this value, and it sorts last.
END = 0xFF
#: Runs that are transformed at once: those of so many bytes, whose arrays stay near the processor.
PART_BYTES = 400_000
DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def sorted_keys(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``key``, and the keys in it. Where key and position fit into one number, sorting values does both, and faster."""
    n = len(key)
    if bits + n.bit_length() > 64:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    shift = np.uint64(n.bit_length())
    both = np.sort((key << shift) | np.arange(n, dtype=np.uint64))
    return (both & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64), both >> shift


def bounded_suffix_order(text: np.ndarray, bound: int) -> np.ndarray:
    """Suffixes in the order of their first ``bound`` bytes (at least 5), by doubling the length that is ranked."""
    n = len(text)
    padded = np.concatenate([text, np.full(bound, END, np.uint8)])
    key, have = np.zeros(n, np.uint64), 5
    for k in range(have):
        key = (key << np.uint64(8)) | padded[k : k + n]
    bits, one = 8 * have, n.bit_length()
    while True:
        order, ranked = sorted_keys(key, bits)
        if have >= bound:
            return order
        rank = np.empty(n + bound, np.uint64)
        steps = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]])
        rank[order] = steps
        rank[n:] = n
        if int(steps[-1]) == n - 1:
            return order
        ahead = min(have, bound - have)
        key = (rank[:n] << np.uint64(one)) | rank[ahead : ahead + n]
        have, bits = have + ahead, 2 * one


def common_prefixes(bwt: np.ndarray, bound: int) -> np.ndarray:
    """Common prefix of each suffix with the one before, in sorted order, from the transform alone: values below ``bound`` as they
    are, ``bound`` for more.

    Breadth-first over the intervals of all strings w, by length: the interval of cw follows from that of w by counting the
    c among the transform's symbols before its ends. An end that no shorter string has marked lies where the common
    prefix is |w|. Only intervals with a new end go on, so that every position is expanded once; after strings
    of length ``bound`` - 1 the positions still unmarked have common prefixes of ``bound`` or more.
    """
    n = len(bwt)
    small = np.int32 if n < 1 << 31 else np.int64
    by_symbol = np.argsort(bwt, kind="stable").astype(small)
    to_front = np.empty(n, small)
    to_front[by_symbol] = np.arange(n, dtype=small)
    before, after = np.full(n, -1, small), np.full(n, n, small)  # the nearest equal symbols
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    ends_run = bwt == END
    before[ends_run], after[ends_run] = n, -1  # such a symbol begins or ends no interval
    common = np.full(n + 1, bound, np.int16)
    common[0] = common[n] = 0
    low, high = np.array([0], small), np.array([n], small)
    for depth in range(bound):
        width = high - low
        total = int(width.sum(dtype=np.int64))
        if not total:
            break
        begin = np.cumsum(width, dtype=small) - width
        at = np.arange(total, dtype=small) + np.repeat(low - begin, width)
        starts = np.sort(to_front[at[before[at] < np.repeat(low, width)]])
        ends = np.sort(to_front[at[after[at] >= np.repeat(high, width)]]) + small(1)
        new = common[ends] == bound
        common[ends[new]] = depth
        low, high = starts[new], ends[new]
    return common[:n]


class TransformResolver:
    """Groups the windows of runs by the intervals of their first ``length`` bytes, as the expansion over their transform bounds them."""

    def __init__(self, length: int):
        self.length = length

    def __call__(self, texts: list[bytes], anchors: np.ndarray, most: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not texts:
            return (np.empty(0, np.int64),) * 3
        sep = bytes([END])
        text = np.frombuffer(sep.join(texts) + sep, np.uint8)
        sizes = np.array([len(t) + 1 for t in texts])
        owner = np.repeat(np.arange(len(texts)), sizes)
        offset = np.arange(len(text)) - (np.cumsum(sizes) - sizes)[owner]
        order = bounded_suffix_order(text, self.length)
        at = np.flatnonzero(common_prefixes(text[order - 1], self.length) < self.length)
        whole = (offset + self.length < sizes[owner])[order]  # a window, not the end of a run
        doc = np.where(whole, least[owner[order]], np.iinfo(np.int64).max)
        by = np.repeat(np.minimum.reduceat(doc, at), np.diff(np.r_[at, len(doc)]))
        some = whole & (by < most[owner[order]])
        hit = order[some]
        return owner[hit], offset[hit], by[some]


def digests(piece: pa.RecordBatch, spans: list) -> list:
    out: list[tuple] = []
    for text, gone in zip(piece.column("text").to_pylist(), spans):
        data, at, digest = (text or "").encode(), 0, hashlib.sha256()
        for a, b in gone:
            digest.update(data[at:a])
            at = b
        digest.update(data[at:])
        out.append((len(data), sum(b - a for a, b in gone), len(gone), digest.hexdigest()))
    return [piece.column("doc_id"), *map(list, zip(*out))]


def repeated_bytes(docs: DataFrame, length: int = 50, anchor: int = 24) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, without the bytes of repeats.

    A byte goes if a ``length``-byte string over it also starts in a row with a smaller doc_id. Null texts are empty; empty
    and shorter texts and rows with a null doc_id lose nothing and take nothing from others; rows with one id take nothing from
    each other; an empty table gives no rows. Spans may cut a character, so kept bytes aren't always UTF-8.
    ``anchor`` is at least 8.
    """
    return with_repeats(docs.select("doc_id", "text"), Bytes(length, anchor), TransformResolver(length), digests, DIGEST, PART_BYTES)
