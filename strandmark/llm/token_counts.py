"""Token counts by a compiled finite-state transducer (operator 1)."""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame

from strandmark.llm.bpe import PieceIds, piece_ids, vocabulary
from strandmark.llm.frames import map_rows

WHITE = b" \t\n\r\x0b\x0c"


class StateMap(NamedTuple):
    """What a chunk does to every entry state at once.

    A state of the transducer is the spelling read since the last white space. All states meet at the first white
    space of a chunk, so the map from entry states needs three values: ``head`` (what is read before the meeting),
    ``count`` (tokens emitted between the first and the last white space) and ``tail`` (the exit state). Without
    white space the chunk only prolongs the state: then ``meets`` is false and ``head`` holds it all.
    """

    head: bytes
    count: int
    tail: bytes
    meets: bool


class TokenCounter(dict):
    """The deterministic transducer: spelling of a state -> tokens emitted by its transition on white space.

    Transitions are compiled on demand from the vocabulary (lazy determinisation) and kept up to a fixed number.
    """

    MOST = 400_000

    def __init__(self, ids: PieceIds):
        super().__init__()
        self.ids = ids

    def __missing__(self, state: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        count = self[state] = len(self.ids.compiled(state.decode())) // 4 if state else 0
        return count

    def chunk(self, data: bytes) -> StateMap:
        """The state map of one chunk, cut anywhere, even inside a character."""
        parts = data.split()
        if not parts:
            return StateMap(b"", 0, b"", bool(data))
        head = b"" if data[:1] in WHITE else parts[0]
        if len(head) == len(data):
            return StateMap(head, 0, b"", False)
        tail = b"" if data[-1:] in WHITE else parts[-1]
        inner = parts[bool(head) : len(parts) - bool(tail)]
        return StateMap(head, sum(map(self.__getitem__, inner)), tail, True)

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """First ``a``, then ``b``; associative."""
        if not a.meets:
            return StateMap(a.head + b.head, b.count, b.tail, b.meets)
        if not b.meets:
            return StateMap(a.head, a.count, a.tail + b.head, True)
        return StateMap(a.head, a.count + self[a.tail + b.head] + b.count, b.tail, True)

    def scan(self, maps: list[StateMap]) -> StateMap:
        """Balanced composition: the up-sweep of a prefix scan, logarithmic in depth."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def tokens(self, data: bytes, chunk_bytes: int) -> int:
        if len(data) <= chunk_bytes:  # one chunk, entered and left in the start state
            return sum(map(self.__getitem__, data.split()))
        all_of_it = self.scan([self.chunk(data[i : i + chunk_bytes]) for i in range(0, len(data), chunk_bytes)])
        return self[all_of_it.head] + all_of_it.count + self[all_of_it.tail]


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(piece_ids(path))


def count_tokens(docs: DataFrame, limit: int = 2048, chunk_bytes: int = 1 << 16, path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``) of every row.

    One narrow pass, no shuffle. Null and empty texts have 0 bytes and 0 tokens; rows with the same or a null
    doc_id stay rows of their own; an empty table gives an empty result; further columns of ``docs`` are not read.
    A text of many chunks is composed by the prefix scan, so that working memory follows the chunk.
    """

    def make():
        transducer = counter(path or vocabulary())

        def work(rows: dict) -> dict:
            data = [(t or "").encode() for t in rows["text"]]
            counts = [transducer.tokens(d, chunk_bytes) for d in data]
            return {"doc_id": rows["doc_id"], "n_bytes": [*map(len, data)], "n_tokens": counts, "over_limit": [n > limit for n in counts]}

        return work

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
