"""Best-fit packing with Martello-Toth dominance reduction (operator 7).

Documents become token pieces of at most ``capacity``; the packing itself depends only on how many pieces there are of
each length. That histogram has at most ``capacity`` rows whatever the corpus, so it alone goes to the driver. There it
becomes *plans* (a list of lengths, and how many sequences are filled that way), and every piece finds its place by its
rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandmark.llm.bpe import piece_ids, vocabulary
from strandmark.llm.frames import map_rows, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Pieces that one ranking window sorts; the number of windows follows the corpus.
RANK_ROWS = 20_000
#: Ranks of a length that meet the runs of places under one key; bounds the runs that a piece is compared with.
RUN_RANKS = 256


class Stock:
    """Counts by length, with the largest present length up to a bound."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.count = [0] * (capacity + 1)
        for length, n in counts.items():
            self.count[length] = n
        self.sizes = sorted(x for x, n in counts.items() if n)

    def fits(self, room: int) -> int:
        """The largest present length of at most ``room``, or 0."""
        at = bisect_right(self.sizes, room)
        return self.sizes[at - 1] if at else 0

    def take(self, length: int, n: int) -> None:
        if n:
            self.count[length] -= n
            if not self.count[length]:
                self.sizes.remove(length)

    def put(self, length: int) -> None:
        if not self.count[length]:
            insort(self.sizes, length)
        self.count[length] += 1

    def smallest(self, n: int) -> list[int]:
        out: list[int] = []
        for size in self.sizes:
            out += [size] * min(n - len(out), self.count[size])
            if len(out) == n:
                break
        return out


def best_pair(stock: Stock, room: int) -> int:
    """The largest sum of two present items within ``room``, or 0."""
    sizes, low, best = stock.sizes, 0, 0
    high = bisect_right(sizes, room) - 1
    while low <= high:
        total = sizes[low] + sizes[high]
        if total > room or low == high and stock.count[sizes[low]] < 2:
            high -= 1
        else:
            best = max(best, total)
            low += 1
    return best


def reduce_by_dominance(stock: Stock, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], Stock]:
    """Sequences that some best packing contains, and the items that are left.

    With an item x, from the longest on, goes y, the longest other that fits. {x, y} dominates every feasible set with x
    if whatever else fits beside x could stand in y's place: nothing else fits; y fills the room exactly; no two others
    fit; or no three fit and the best two together are no longer than y. Equal sequences are fixed at once. Items
    without a dominating set stay, and count as others for all that follow.
    """
    fixed = []
    for x in sorted(stock.sizes, reverse=True):
        while stock.count[x]:
            stock.take(x, 1)
            room = capacity - x
            y = stock.fits(room)
            low = stock.smallest(3)
            if y == 0:
                n = stock.count[x] + 1
                stock.take(x, n - 1)
                fixed.append(((x,), n))
            elif y == room or sum(low[:2]) > room or len(low) < 2 or (sum(low) > room or len(low) < 3) and best_pair(stock, room) <= y:
                # each of these stays true as items go, so all such pairs at once
                n = (stock.count[x] + 1) // 2 if x == y else min(stock.count[x] + 1, stock.count[y])
                stock.take(x, 2 * n - 1 if x == y else n - 1)
                stock.take(y, 0 if x == y else n)
                fixed.append(((x, y), n))
            else:
                stock.put(x)
                break
    return fixed, stock


def best_fit(stock: Stock, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, longest first, for whole multiplicities: the fullest open sequences with room take an item each."""
    open_by_room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []
    for x in sorted(stock.sizes, reverse=True):
        n = stock.count[x]
        while n:
            at = bisect_right(rooms, x - 1)
            if at == len(rooms):  # nothing has room: new sequences, as full of x as they get
                each = min(capacity // x, n)
                plans, m = [((x,) * each, n // each)], n // each
                n -= each * m
                room = capacity - each * x
            else:
                room = rooms[at]
                plan, m = open_by_room[room].pop()
                used = min(m, n)
                if used < m:
                    open_by_room[room].append((plan, m - used))
                if not open_by_room[room]:
                    del open_by_room[room], rooms[at]
                plans, room, n = [((*plan, x), used)], room - x, n - used
            if room not in open_by_room:
                rooms.insert(bisect_right(rooms, room), room)
            open_by_room.setdefault(room, []).extend(plans)
    return [plan for plans in open_by_room.values() for plan in plans]


def plan_packing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in one sequence, number of such sequences): dominance reduction, then best fit of the rest."""
    full = [((capacity,), counts[capacity])] if counts.get(capacity) else []
    fixed, rest = reduce_by_dominance(Stock({k: n for k, n in counts.items() if 0 < k < capacity and n}, capacity), capacity)
    return full + fixed + best_fit(rest, capacity)


def places(plans: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int]]:
    """(length, first rank, first sequence, offset): pieces of that length, from that rank on, fill sequences in order."""
    out, ranks, first = [], Counter(), 0
    for lengths, n in plans:
        offsets = accumulate(lengths, initial=0)
        for length, offset in zip(lengths, offsets):
            out.append((length, ranks[length], first, offset))
            ranks[length] += n
        first += n
    return sorted(out)


def run_ends(found: list[tuple[int, int, int, int]], counts: dict[int, int]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end of ranks, first sequence, offset): a run ends where the next of its length starts."""
    after = [*found[1:], (0, 0, 0, 0)]
    return [(x, rank, rank_after if x == y else counts[x], sequence, offset) for (x, rank, sequence, offset), (y, rank_after, _, _) in zip(found, after)]


def tokenized(docs: DataFrame, capacity: int, end_id: int, path: str | None = None) -> DataFrame:
    """The pieces of every row: ids, then ``end_id``, cut only where a document exceeds ``capacity``."""
    end = end_id.to_bytes(4, "little")

    def make():
        ids = piece_ids(path or vocabulary())

        def work(rows: dict) -> dict:
            out = []
            for doc, text in zip(rows["doc_id"], rows["text"]):
                data = ids.text(text) + end
                for k, i in enumerate(range(0, len(data), 4 * capacity)):
                    cut = data[i : i + 4 * capacity]
                    out.append((doc, k, i // 4, len(cut) // 4, zlib.crc32(cut)))
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            return dict(zip(names, map(list, zip(*out)), strict=True)) if out else {n: [] for n in names}

        return work

    return map_rows(docs.select("doc_id", "text"), make, PIECES)


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 1, path: str | None = None) -> DataFrame:
    """Packs all rows into sequences of at most ``capacity`` tokens; a row for each piece with its place.

    Null and empty texts are the end token alone. Equal lengths are ranked by doc_id, piece and checksum; repeated rows
    and null ids get places of their own, in any order. An empty table gives no rows. Other columns aren't read.
    Texts are tokenised once: the small pieces are written to the shared store. To the driver goes the histogram of
    lengths (at most ``capacity`` rows); the runs of places that follow from it are joined by length and range of ranks.
    """
    spark = docs.sparkSession
    pieces = written(tokenized(docs, capacity, end_id, path), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    found = places(plan_packing(counts, capacity))
    groups = max(16, sum(counts.values()) // RANK_ROWS)
    dealt = pieces.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    before = Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "_g").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("_g", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1).join(offsets, ["length", "_g"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    # a run of places is cut at multiples of RUN_RANKS, so that it meets its pieces by an equal key, in any number
    runs = spark.createDataFrame(run_ends(found, counts), "length long, _start long, _end long, _sequence long, _offset long")
    blocks = F.sequence(F.floor(F.col("_start") / RUN_RANKS), F.floor((F.col("_end") - 1) / RUN_RANKS))
    cut = runs.withColumn("_block", F.explode(blocks))
    pieces_in = ranked.withColumn("_block", F.floor(F.col("_rank") / RUN_RANKS))
    placed = pieces_in.join(cut, ["length", "_block"]).filter("_start <= _rank and _rank < _end")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_sequence") + F.col("_rank") - F.col("_start")).alias("sequence_id"), F.col("_offset").alias("offset"))
