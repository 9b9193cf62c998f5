"""Substring dedup with suffix automata of reference shards (operator 9)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from strandmark.llm.anchors import Words, with_repeats
from strandmark.llm.frames import map_rows, written

#: A word with the white space before it.
SPACED = regex.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+")
DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class SuffixAutomaton:
    """All substrings of several word sequences; each state knows the least document that has its strings.

    Words are numbers within the automaton. States are rows of parallel lists: ``length`` of the longest string, ``link`` to
    the longest suffix in another state, ``step`` by word, ``least`` id. Sequences are added one by one (a
    generalised automaton: transitions that exist are followed, or split where the lengths disagree).
    """

    def __init__(self):
        self.length, self.link, self.step, self.least = [0], [-1], [{}], [None]

    def state(self, length: int, link: int, step: dict) -> int:
        self.length.append(length)
        self.link.append(link)
        self.step.append(step)
        self.least.append(None)
        return len(self.length) - 1

    def split(self, p: int, word, q: int) -> int:
        """A copy of ``q`` for the strings of ``q`` no longer than those of ``p`` and the word."""
        length, link, step = self.length, self.link, self.step
        copy = self.state(length[p] + 1, link[q], step[q].copy())
        self.least[copy] = self.least[q]
        while p >= 0 and step[p].get(word) == q:
            step[p][word] = copy
            p = link[p]
        link[q] = copy
        return copy

    def add(self, words: list, doc: int) -> None:
        length, link, step, least = self.length, self.link, self.step, self.least
        last = 0
        for word in words:
            q = step[last].get(word)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self.split(last, word, q)
            else:
                new, p = self.state(length[last] + 1, 0, {}), last
                while p >= 0 and word not in step[p]:
                    step[p][word] = new
                    p = link[p]
                if p >= 0:
                    q = step[p][word]
                    link[new] = q if length[q] == length[p] + 1 else self.split(p, word, q)
                last = new
            if least[last] is None or doc < least[last]:
                least[last] = doc

    def close(self) -> None:
        """Hands the least ids down the links, longest states first."""
        least, link = self.least, self.link
        for v in sorted(range(1, len(least)), key=self.length.__getitem__, reverse=True):
            u = link[v]
            if u > 0 and least[v] is not None and (least[u] is None or least[v] < least[u]):
                least[u] = least[v]

    def matched(self, words: list, threshold: int):
        """(end, least document) wherever the matching statistic, bounded by ``threshold``, reaches it."""
        length, link, step, least = self.length, self.link, self.step, self.least
        v, n = 0, 0
        for i, word in enumerate(words, 1):
            while v and word not in step[v]:
                v = link[v]
                n = length[v]
            v = step[v].get(word, 0)
            n = n + 1 if v else 0
            if n >= threshold:
                while length[link[v]] >= threshold:
                    v = link[v]
                n = threshold
                yield i, least[v]


class AutomatonResolver:
    """Suffix automata of reference shards; all runs with the shard's anchor stream through for their matching statistics.

    Runs with other anchors share no window. The runs of one anchor are one shard, or several of ``shard_words`` words: then
    each shard's automaton is built in turn, and the least document of a window is the least that any of them gives.
    """

    def __init__(self, length: int, shard_words: int = 50_000):
        self.length, self.shard_words = length, shard_words

    def shards(self, split: list[list[bytes]], ids: list[int]):
        """Closed automata over the runs, each of about ``shard_words`` words."""
        automaton, held = SuffixAutomaton(), 0
        for words, doc in zip(split, ids):
            if held >= self.shard_words:
                automaton.close()
                yield automaton
                automaton, held = SuffixAutomaton(), 0
            automaton.add(words, doc)
            held += len(words)
        automaton.close()
        yield automaton

    def __call__(self, texts: list[bytes], anchors: np.ndarray, most: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found: list[tuple[int, int, int]] = []
        order = np.argsort(anchors, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(anchors[order])) + 1):
            split = [texts[i].split(b" ") for i in part.tolist()]
            for automaton in self.shards(split, least[part].tolist()):
                for i, words, high in zip(part.tolist(), split, most[part].tolist()):
                    found += [(i, end - self.length, doc) for end, doc in automaton.matched(words, self.length) if doc < high]
        which, window, by = np.array(found, np.int64).reshape(-1, 3).T
        order = np.lexsort((by, window, which))
        which, window, by = which[order], window[order], by[order]
        first = np.r_[True, (which[1:] != which[:-1]) | (window[1:] != window[:-1])] if len(which) else np.empty(0, bool)
        return which[first], window[first], by[first]


def cut_words(text: str, spans: list) -> str:
    """The text without the words of the spans and the white space before each."""
    data, at, out = text.encode(), 0, []
    words = SPACED.findall(data)
    for a, b in spans:
        out += words[at:a]
        at = b
    return b"".join([*out, *words[at:]]).strip().decode() if spans else text


def digests(piece: pa.RecordBatch, spans: list) -> list:
    n_words, n_removed, kept = [], [], []
    for text, gone in zip(piece.column("text").to_pylist(), spans):
        words = (text or "").encode().split()
        removed = sum(b - a for a, b in gone)
        for a, b in reversed(gone):
            del words[a:b]
        n_words.append(len(words) + removed)
        n_removed.append(removed)
        kept.append(hashlib.sha256(b" ".join(words)).hexdigest())
    return [piece.column("doc_id"), n_words, n_removed, kept]


def repeated_spans(docs: DataFrame, length: int = 13, anchor: int = 5) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row: see ``remove_repeats``. Other columns aren't read."""
    return with_repeats(docs.select("doc_id", "text"), Words(length, anchor), AutomatonResolver(length), digests, DIGEST)


def remove_repeats(docs: DataFrame, length: int = 13, anchor: int = 5) -> DataFrame:
    """``docs``, all columns, their texts without the words of any ``length``-word window of a smaller doc_id.

    Words are runs without ASCII white space; kept words keep the white space before them, and texts without a repeat
    stay as they are. An n_chars column is counted anew; other columns, whatever their names, come through as they are. Null and
    empty texts, texts shorter than a window and rows with a null doc_id lose nothing and take nothing from others; rows that
    share an id take nothing from each other; repeated rows stay rows; an empty table gives no rows. A very long text is
    held by its own task alone, in the end with about 100 bytes a word.
    """
    names = docs.columns

    def make(piece: pa.RecordBatch, spans: list) -> list:
        row = piece.column("row").flatten() if "row" in piece.schema.names else []
        own = dict(zip((n for n in names if n not in ("doc_id", "text")), row)) | {"doc_id": piece.column("doc_id")}
        own["text"] = [t if t is None else cut_words(t, s) for t, s in zip(piece.column("text").to_pylist(), spans)]
        if "n_chars" in own:
            own["n_chars"] = pa.array([n if not s else len(t) for n, t, s in zip(own["n_chars"].to_pylist(), own["text"], spans)], own["n_chars"].type)
        return [own[n] for n in names]

    return with_repeats(docs, Words(length, anchor), AutomatonResolver(length), make, docs.schema)


def remove_known(docs: DataFrame, reference: DataFrame, length: int = 13, shard_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, text without the words under any ``length``-word window that a reference text has.

    The reference comes in shards of at most ``shard_bytes`` characters (a longer text is a shard of its own); each
    shard's automaton is broadcast and all documents stream through it into a written table, so one is held at a time. Meant for a
    reference far smaller than the corpus; a corpus against itself is ``remove_repeats``. Null texts stay null and match nothing;
    repeated rows and ids stay rows, ties don't matter; an empty reference removes nothing, an empty table gives no rows; other
    columns aren't read. A very long text is held by its own task alone.
    """
    from strandmark.llm.decontaminate import blocks_of, with_last

    context = docs.sparkSession.sparkContext
    names = reference.columns
    df = docs.selectExpr("doc_id", "text", "cast(array() as array<long>) as spans")
    for part, last in with_last(blocks_of(reference.selectExpr(f"`{names[0]}` as item_id", "text"), shard_bytes)):
        shared = context.broadcast([t for _, t in part if t])

        def make_part(shared=shared):
            automaton = SuffixAutomaton()
            for text in shared.value:
                automaton.add(text.encode().split(), 0)
            automaton.close()

            def work(rows: dict) -> dict:
                for text, spans in zip(rows["text"], rows["spans"]):
                    for end, _ in automaton.matched((text or "").encode().split(), length):
                        if spans and spans[-1] >= end - length and spans[-2] <= end - length:
                            spans[-1] = end
                        else:
                            spans += (end - length, end)
                return rows

            return work

        df = map_rows(df, make_part, "doc_id long, text string, spans array<long>")
        if not last:
            df = written(df, "searched")
            shared.unpersist()

    def make_last():
        def work(rows: dict) -> dict:
            out = []
            for text, spans in zip(rows["text"], rows["spans"]):
                merged: list[list[int]] = []
                for a, b in sorted(zip(spans[::2], spans[1::2])):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                out.append(text if text is None else cut_words(text, merged))
            return {"doc_id": rows["doc_id"], "text": out}

        return work

    return map_rows(df, make_last, "doc_id long, text string")
