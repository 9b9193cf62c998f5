"""Finding the strings of a fixed length that documents share, without pairs and without moving all of the text.

Every window of ``length`` symbols (bytes or words) is filed under the least hash of the ``anchor``-symbol strings in it.
That anchor depends on the window alone, so equal windows of any documents meet. Consecutive windows with one anchor are
a *run*; what goes over the wire is one anchor a run, then the texts of runs whose anchor other documents have too:

1. anchors of each document, combined in the task -> buckets of anchors; shared ones are told to the documents' groups
2. runs of shared anchors, equal ones combined in the task -> shards; a *resolver* compares all runs of a shard
3. covered spans -> back to the documents' groups, where the result is made

A passage or a copy, however frequent, sends one entry a task: entries of one task are merged before each shuffle. An anchor sends
a number of owners and their groups, each group once for every million anchors of a task.
An anchor with ``HOT_OWNERS`` owners or more may stand in as many different contexts; the groups that have it are told so too,
and file each of its windows under a digest of the whole window instead, so that only equal windows meet under one key.
Groups, buckets and shards are hashes whose number follows the amount of text. Rows go by doc_id and a hash of doc_id and
text, so repeated ids do no harm.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from strandmark.llm.frames import grams, mixed, slices, tidy, tidy_group, tidy_pair, word_hashes

#: Text in one group of documents, in one bucket of anchors, and in one shard of runs (about a quarter of all text, five times over).
GROUP_BYTES, BUCKET_BYTES, SHARD_BYTES = 8 << 20, 16 << 20, 8 << 20
LEAST_GROUPS, LEAST_BUCKETS, LEAST_SHARDS = 256, 64, 128
#: Runs of a shard that a resolver has at once are those of so many bytes.
PART_BYTES = 1_500_000
#: Rows with one anchor, from which its windows are dealt one by one.
HOT_OWNERS = 4096
#: What moves: a place to go, and arrays packed into one value. Kinds of the packets for shards:
PACKET, ANCHORS, RUNS = "g int, data binary", "bucket int, g int, data binary", "shard int, kind int, g int, data binary"
DONE, RUN, WINDOW = 0, 1, 2


def arrow(schema: str) -> pa.Schema:
    """The Arrow form of the flat schemas above; needs no session, so tasks can call it."""
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def joined(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays as one value; ``parted`` takes them apart."""
    parts = [x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for x in arrays]
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def parted(data: bytes, *kinds: type) -> list:
    sizes = struct.unpack_from(f"<{len(kinds)}I", data)
    cuts = np.cumsum([4 * len(kinds), *sizes]).tolist()
    return [data[a:b] if kind is bytes else np.frombuffer(data[a:b], kind) for kind, a, b in zip(kinds, cuts, cuts[1:])]


def packed(data: bytes) -> bytes:
    """Runs overlap and repeat, and numbers are small: packed well they take much less than what the shuffle leaves."""
    return struct.pack("<I", len(data)) + pa.compress(data, codec="zstd", asbytes=True)


def expanded(data: bytes) -> bytes:
    return pa.decompress(data[4:], struct.unpack("<I", data[:4])[0], codec="zstd", asbytes=True)


def table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(arrow(schema))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow(schema))], schema=arrow(schema))


class Bytes:
    """Texts as UTF-8 bytes."""

    def __init__(self, length: int, anchor: int):
        self.length, self.anchor = length, anchor

    def load(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Callable]:
        """Ends of the texts in symbols, hash of each anchor-long string, and a way to cut out symbols."""
        data = b"".join(texts)
        n = len(data) - self.anchor + 1
        ends = np.cumsum([*map(len, texts)])
        cut = lambda first, stop: [data[a:b] for a, b in zip(first.tolist(), stop.tolist())]
        if n <= 0:
            return ends, np.empty(0, np.uint64), cut
        eights = np.empty(len(data) - 7, np.uint64)  # the eight bytes from each place on
        for k in range(min(8, len(eights))):
            eights[k::8] = np.frombuffer(data, np.uint64, (len(data) - k) // 8, k)
        total = np.zeros(n, np.uint64)
        for k, at in enumerate((*range(0, self.anchor - 8, 8), self.anchor - 8)):
            part = eights[at : at + n] * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 3)) & (2**64 - 1) | 1)
            total ^= part >> np.uint64(29)
            total += part
        return ends, mixed(total), cut


class Words:
    """Texts as runs without ASCII white space; a piece of them is those words joined by single spaces."""

    def __init__(self, length: int, anchor: int):
        self.length, self.anchor = length, anchor

    def load(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, Callable]:
        data = b"\n".join(texts)
        hashes, starts, ends = word_hashes(data)
        counts = np.diff(np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)])))
        cut = lambda first, stop: [b" ".join(data[a:b].split()) for a, b in zip(starts[first].tolist(), ends[stop - 1].tolist())]
        return np.cumsum(counts), grams(hashes, self.anchor), cut


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    have = 1
    while 2 * have <= width:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    rest = width - have
    return np.minimum(h[:-rest], h[rest:]) if rest else h


def runs(units, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable]:
    """(first window, windows, anchor, text) of each run, the first symbol of each text, and the cutter."""
    ends, hashes, cut = units.load(texts)
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    n = (int(ends[-1]) if len(ends) else 0) - units.length + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none.astype(np.uint64), none, starts, cut
    least = sliding_min(hashes, units.length - units.anchor + 1)
    valid = np.ones(n, bool)
    for end in ends.tolist():
        valid[max(0, end - units.length + 1) : end] = False
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= new[1:] | ~valid[1:]
    windows = np.flatnonzero(stop) - first + 1
    return first, windows, least[first], np.searchsorted(ends, first, side="right"), starts, cut


def by_value(kinds: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """Each value of ``kinds`` that occurs, with the parts of the arrays that belong to it."""
    if len(kinds):
        order = np.argsort(kinds, kind="stable")
        cuts = np.flatnonzero(np.diff(kinds[order])) + 1
        for part in np.split(order, cuts):
            yield int(kinds[part[0]]), *(x[part] for x in arrays)


def merged_spans(owner: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans of an owner become one; ``spans`` has start and end columns."""
    if not len(owner):
        return owner, spans
    order = np.lexsort((spans[:, 0], owner))
    owner, spans = owner[order], spans[order].astype(np.int64)
    far = owner.astype(np.int64) << 33  # one line for all owners; a text has fewer than 2 ** 32 symbols
    reach = np.maximum.accumulate(far + spans[:, 1])
    new = np.r_[True, far[1:] + spans[1:, 0] > reach[:-1]]
    at = np.flatnonzero(new)
    ends = reach[np.r_[at[1:] - 1, len(owner) - 1]] - far[at]
    return owner[at], np.stack([spans[at, 0], ends], 1).astype(np.uint32)


def spans_by_group(keys: np.ndarray, owner: np.ndarray, spans: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """Packets for the groups of the owners, whose ``keys`` are (doc_id, hash): spans (start, end) merged by owner."""
    owner, spans = merged_spans(owner, spans)
    for g, o, s in by_value(keys[owner, 1] % groups if len(owner) else owner, owner, spans):
        which, counts = np.unique(o, return_counts=True)  # merged spans come in the order of their owners
        yield g, joined(keys[which], counts.astype(np.uint32), s)


def keyed(docs: DataFrame, groups: int) -> DataFrame:
    """doc_id, text, row (the other columns, under any names), and what moves by: k, a hash of doc_id and text, and the group g."""
    others = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c not in ("doc_id", "text")]
    k = F.xxhash64("doc_id", "text")
    return docs.select("doc_id", "text", *([F.struct(*others).alias("row")] if others else []), k.alias("k"), F.pmod(k, F.lit(groups)).cast("int").alias("g"))


def find_anchors(docs: DataFrame, units, buckets: int, groups: int, flush: int = 1_000_000) -> DataFrame:
    """Step 1: anchors by bucket. Those that two documents of a task share are told at once; their counts and groups follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        anchors: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        held = rows = 0

        def out():
            a, o, k = map(np.concatenate, (anchors, owners, keys))
            keys.clear(), anchors.clear(), owners.clear()
            order = np.argsort(a, kind="stable")
            a, o = a[order], o[order]
            at = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            sizes = np.diff(np.r_[at, len(a)])
            common = np.minimum.reduceat(o, at) != np.maximum.reduceat(o, at)
            inside = np.repeat(common, sizes)
            bucket = (a % np.uint64(buckets)).astype(np.int64)
            short = (a >> np.uint64(32)).astype(np.uint32)
            told = (bucket[inside].astype(np.uint64) << np.uint64(32)) | short[inside]
            owned = k[o[inside]]
            found = [(g % buckets, g, joined(x, v)) for g, x, v in by_value(owned % groups, owned, told)]
            single = np.flatnonzero(~inside)
            single = single[np.argsort(o[single], kind="stable")]
            alone = {b: (v, x) for b, v, x in by_value(bucket[single], short[single], k[o[single]])}
            # of an anchor that several documents have: how many, and their groups, each once
            number = np.repeat(np.arange(len(at)), sizes)[inside] * groups + owned % groups
            number, where = np.divmod(np.unique(number), groups)
            many, n_groups = at[common], np.bincount(number, minlength=len(at))[common]
            several = {}
            for b, v, n, m, stop in by_value(bucket[many], short[many], sizes[common], n_groups, np.cumsum(n_groups)):
                several[b] = v, n.astype(np.uint32), m.astype(np.uint32), np.concatenate([where[e - i : e] for e, i in zip(stop.tolist(), m.tolist())]).astype(np.int32)
            none = np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(0, np.int32)
            for b in alone.keys() | several.keys():
                found.append((b, -1, joined(*alone.get(b, none[:2]), *several.get(b, none))))
            return table(ANCHORS, found)

        for piece in slices(batches, limit=1 << 20):
            _, _, a, text, _, _ = runs(units, piece.column(0).cast(pa.binary()).to_pylist())
            order = np.lexsort((a, text))
            a, text = a[order], text[order]
            once = np.r_[True, (a[1:] != a[:-1]) | (text[1:] != text[:-1])] if len(a) else np.empty(0, bool)
            anchors.append(a[once])
            owners.append(text[once] + rows)
            keys.append(piece.column(1).to_numpy())
            held += int(once.sum())
            rows += piece.num_rows
            if held >= flush:
                yield out()
                held = rows = 0
        if held:
            yield out()

    return docs.filter("text is not null").select("text", "k").mapInArrow(tidy(run), ANCHORS)


def tell_shared(found: DataFrame, groups: int, hot_owners: int) -> DataFrame:
    """Within a bucket: anchors that come from two owners, or are common within a task, are told to the owners' groups, and the hot
    ones once more as such. A packet has keys, their anchors, hot anchors."""

    def run(rows: pa.Table) -> pa.Table:
        at_once = [(g, joined(*parted(d, np.int64, np.uint64), b"")) for g, d in zip(rows.column("g").to_pylist(), rows.column("data").to_pylist()) if g >= 0]
        rest = [parted(d, np.uint32, np.int64, np.uint32, np.uint32, np.uint32, np.int32) for g, d in zip(rows.column("g").to_pylist(), rows.column("data").to_pylist()) if g < 0]
        if rest:
            v, k, common, owners, counts, where = map(np.concatenate, zip(*rest))
            order = np.argsort(v, kind="stable")
            v, k = v[order], k[order]
            same = v[1:] == v[:-1]
            shared = (np.r_[False, same] | np.r_[same, False]) if len(v) else np.empty(0, bool)
            shared |= np.isin(v, common)
            v, k = v[shared], k[shared]
            every, of = np.unique(np.concatenate([v, common]), return_inverse=True)
            hot = every[np.bincount(of, np.concatenate([np.ones(len(v)), owners]), len(every)) >= hot_owners]
            base = np.uint64(rows.column("bucket")[0].as_py()) << np.uint64(32)
            told = {g: (x, y) for g, x, y in by_value(k % groups, k, v)}
            flags: dict[int, np.ndarray] = {}
            if len(hot):
                of, at = np.concatenate([v, np.repeat(common, counts)]), np.concatenate([k % groups, where])
                some = np.isin(of, hot)
                flags = {g: np.unique(x) for g, x in by_value(at[some], of[some])}
            none = np.empty(0, np.int64), np.empty(0, np.uint32)
            for g in told.keys() | flags.keys():
                x, y = told.get(g, none)
                at_once.append((g, joined(x, base | y.astype(np.uint64), base | flags.get(g, none[1]).astype(np.uint64))))
        return pa.Table.from_batches([table(PACKET, at_once)])

    return found.groupBy("bucket").applyInArrow(tidy_group(run), PACKET)


class Collected:
    """What the documents of a group have under shared anchors: of equal strings only the least document's go on, others are covered."""

    def __init__(self):
        self.first_of: dict[bytes, list] = {}
        self.done: list[tuple[int, int, int]] = []

    def add(self, data: bytes, anchor: int, doc: int, owner: int, start: int, size: int) -> None:
        known = self.first_of.get(data)
        if known is None:
            self.first_of[data] = [anchor, size, [(doc, owner, start)]]
            return
        places = known[2]
        least = places[0][0]
        if least == doc:
            places.append((doc, owner, start))
        elif least < doc:
            self.done.append((owner, start, start + size))
        else:
            self.done += [(o, s, s + size) for _, o, s in places]
            known[2] = [(doc, owner, start)]


def collect_runs(docs: DataFrame, told: DataFrame, units, buckets: int, shards: int, groups: int) -> DataFrame:
    """Step 2: the runs of shared anchors by shard, and the windows of hot ones by their digest."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return pa.Table.from_batches([], schema=arrow(RUNS))
        owner_key, value, hot = map(np.concatenate, zip(*(parted(d, np.int64, np.uint64, np.uint64) for d in right.column("data").to_pylist())))
        wanted, hot, with_some = np.unique(value ^ mixed(owner_key.view(np.uint64))), np.unique(hot), np.unique(owner_key)
        g = right.column("g")[0].as_py()
        keys: list[tuple] = []
        whole, single = Collected(), Collected()
        for piece in slices(left.select(["text", "doc_id", "k"]).to_batches(), limit=1 << 20):
            piece = piece.filter(pa.array(np.isin(piece.column(2).to_numpy(), with_some)))
            rows = {(d, k): t for t, d, k in zip(piece.column(0).cast(pa.binary()).to_pylist(), *(piece.column(i).to_pylist() for i in (1, 2))) if t is not None}  # a repeated row once
            if not rows:
                continue
            first, windows, a, text, starts, cut = runs(units, [*rows.values()])
            composite = ((a % np.uint64(buckets)) << np.uint64(32)) | (a >> np.uint64(32))
            k = np.array([k for _, k in rows], np.int64).view(np.uint64)
            hits = np.flatnonzero(np.isin(composite ^ mixed(k)[text], wanted))
            is_hot = np.isin(composite[hits], hot)
            me, ids, base = len(keys), [d for d, _ in rows], starts[text]
            keys += rows
            for store, part in ((whole, hits[~is_hot]), (single, hits[is_hot])):
                at, n = first[part], windows[part]
                if store is single:  # each window by itself
                    at = np.repeat(at - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
                    part, n = np.repeat(part, n), np.ones(len(at), np.int64)
                sizes = n + units.length - 1
                data = cut(at, at + sizes)
                if store is single:
                    data = map(xxhash.xxh3_128_digest, data)
                which = text[part]
                for args in zip(data, a[part].tolist(), map(ids.__getitem__, which.tolist()), (which + me).tolist(), (at - base[part]).tolist(), sizes.tolist()):
                    store.add(*args)
        out = []
        k = np.array(keys, np.int64).reshape(-1, 2)
        done = np.array(whole.done + single.done, np.int64).reshape(-1, 3)
        out += [(g % shards, DONE, to, data) for to, data in spans_by_group(k, done[:, 0], done[:, 1:], groups)]
        by_shard: dict[tuple, list] = {}
        for data, (anchor, _, places) in whole.first_of.items():
            by_shard.setdefault((anchor % 0xFFFFFFFB % shards, RUN), []).append((data, anchor >> 32, places))
        for data, (_, _, places) in single.first_of.items():
            by_shard.setdefault((int.from_bytes(data[:4], "little") % shards, WINDOW), []).append((data, 0, places))
        for (shard, kind), items in by_shard.items():
            which = np.repeat(np.arange(len(items)), [len(x[2]) for x in items])
            owner, start = np.array([p[1:] for x in items for p in x[2]]).T
            used, owner = np.unique(owner, return_inverse=True)
            about = np.array([[len(x[0]) for x in items], [x[1] for x in items]], np.uint32)
            out.append((shard, kind, g, joined(k[used], packed(np.array([which, owner, start], np.uint32).tobytes()), packed(about.tobytes()), packed(b"".join(x[0] for x in items)))))
        return pa.Table.from_batches([table(RUNS, out)])

    return docs.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(tidy_pair(run), RUNS)


class Packets:
    """Strings of the packets of a shard, and the places that they have: string, document, owner, start."""

    def __init__(self, data: list[bytes]):
        keys, which, owners, starts, sizes, anchors, self.text = [], [], [], [], [], [], []
        strings = rows = 0
        for k, places, about, text in (parted(d, np.int64, bytes, bytes, bytes) for d in data):
            w, o, s = np.frombuffer(expanded(places), np.uint32).astype(np.int64).reshape(3, -1)
            n, a = np.frombuffer(expanded(about), np.uint32).reshape(2, -1)
            for x, y in ((keys, k.reshape(-1, 2)), (which, w + strings), (owners, o + rows), (starts, s), (sizes, n), (anchors, a), (self.text, expanded(text))):
                x.append(y)
            strings += len(n)
            rows += len(k) // 2
        self.keys, self.which, self.owner, self.start, self.size, self.anchor = map(np.concatenate, (keys, which, owners, starts, sizes, anchors))
        self.text = b"".join(self.text)
        self.doc = self.keys[self.owner, 0]
        self.end = np.cumsum(self.size, dtype=np.int64)

    def parts(self, limit: int) -> Iterator[np.ndarray]:
        """Numbers of strings, whole anchors together, in parts of about ``limit`` bytes."""
        order = np.argsort(self.anchor, kind="stable")
        reach = np.cumsum(self.size[order], dtype=np.int64)
        new = np.r_[True, np.diff(self.anchor[order]) != 0]
        block = np.maximum.accumulate(np.where(new, (reach - self.size[order]) // limit, 0))
        yield from np.split(order, np.flatnonzero(np.diff(block)) + 1)


#: runs, anchors, greatest document by run, least document by run -> number of run, window, least document that has it
Resolver = Callable[[list[bytes], np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def covered_runs(p: Packets, part: np.ndarray, resolver: Resolver, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Owners and spans that windows of smaller documents cover, among the strings of ``part``."""
    number: dict[bytes, int] = {}
    of = np.full(len(p.size), -1)
    for i in part.tolist():
        of[i] = number.setdefault(p.text[p.end[i] - p.size[i] : p.end[i]], len(number))
    mine = np.flatnonzero(of[p.which] >= 0)
    run, doc = of[p.which[mine]], p.doc[mine]
    most, least = np.full(len(number), np.iinfo(np.int64).min), np.full(len(number), np.iinfo(np.int64).max)
    np.maximum.at(most, run, doc)
    np.minimum.at(least, run, doc)
    anchor = np.zeros(len(number), np.uint32)
    anchor[of[part]] = p.anchor[part]
    several = np.zeros(len(number), bool)  # an anchor that one document has needs no comparison
    _, group = np.unique(anchor, return_inverse=True)
    low, high = np.full(len(number), np.iinfo(np.int64).max), np.full(len(number), np.iinfo(np.int64).min)
    np.minimum.at(low, group, least)
    np.maximum.at(high, group, most)
    several = (low != high)[group]
    texts = [t for t, i in number.items() if several[i]]
    which, window, by = resolver(texts, anchor[several], most[several], least[several])
    which = np.flatnonzero(several)[which]
    # every place of a run with the windows found in it
    order = np.argsort(which, kind="stable")
    which, window, by = which[order], window[order], by[order]
    begin, n = np.searchsorted(which, run), np.bincount(which, minlength=len(number))[run]
    at = np.repeat(begin - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum())) if len(run) else run
    place = np.repeat(np.arange(len(run)), n)
    hit = by[at] < doc[place]
    start = p.start[mine[place[hit]]] + window[at[hit]]
    return p.owner[mine[place[hit]]], np.stack([start, start + length], 1)


def covered_windows(p: Packets, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for windows by their digest, 16 bytes each."""
    digest = np.frombuffer(p.text, np.uint64).reshape(-1, 2)[p.which]
    order = np.lexsort((p.doc, digest[:, 0], digest[:, 1]))
    sorted_digest = digest[order]
    new = np.r_[True, (sorted_digest[1:] != sorted_digest[:-1]).any(axis=1)]
    least = p.doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    hit = order[p.doc[order] > least]
    return p.owner[hit], np.stack([p.start[hit], p.start[hit] + length], 1)


def resolve(collected: DataFrame, resolver: Resolver, length: int, groups: int, part_bytes: int) -> DataFrame:
    """Step 3, within a shard: which windows also start in a smaller document.

    All runs go through ``resolver`` with the ids of their documents, equal ones once, in parts of bounded size that keep anchors whole.
    """

    def run(rows: pa.Table) -> pa.Table:
        by_kind: dict[int, list] = {DONE: [], RUN: [], WINDOW: []}
        for kind, g, data in zip(*(rows.column(n).to_pylist() for n in ("kind", "g", "data"))):
            by_kind[kind].append((g, data))
        out = by_kind[DONE]
        for kind in (RUN, WINDOW):
            if by_kind[kind]:
                p = Packets([d for _, d in by_kind[kind]])
                found = [covered_windows(p, length)] if kind == WINDOW else [covered_runs(p, part, resolver, length) for part in p.parts(part_bytes)]
                out += spans_by_group(p.keys, *map(np.concatenate, zip(*found)), groups)
        return pa.Table.from_batches([table(PACKET, out)])

    return collected.groupBy("shard").applyInArrow(tidy_group(run), PACKET)


#: piece of a table, spans of each row -> the result's columns
Maker = Callable[[pa.RecordBatch, list], list]


def made(make: Maker, schema: pa.Schema, piece: pa.RecordBatch, spans: list) -> pa.RecordBatch:
    columns = make(piece, spans)
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema)], names=schema.names)


def finish(docs: DataFrame, spans: DataFrame, make: Maker, schema: StructType) -> DataFrame:
    """Step 4: ``make(piece, spans of each row)`` in each group of documents; all rows come through."""
    result = to_arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        index: dict[tuple, int] = {}
        of_row = [index.setdefault(key, len(index)) for key in zip(left.column("doc_id").to_pylist(), left.column("k").to_pylist())]
        row, span = [np.empty(0, np.int64)], [np.empty((0, 2), np.uint32)]
        for keys, counts, s in (parted(d, np.int64, np.uint32, np.uint32) for d in right.column("data").to_pylist()):
            row.append(np.repeat([index[d, k] for d, k in keys.reshape(-1, 2).tolist()], counts))
            span.append(s.reshape(-1, 2))
        row, span = merged_spans(np.concatenate(row), np.concatenate(span))
        cuts = np.searchsorted(row, np.arange(len(index) + 1)).tolist()
        found, at, done = span.tolist(), 0, []
        for piece in slices(left.to_batches()):
            own = of_row[at : at + piece.num_rows]
            at += piece.num_rows
            done.append(made(make, result, piece, [found[cuts[i] : cuts[i + 1]] for i in own]))
        return pa.Table.from_batches(done) if done else result.empty_table()

    return docs.groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(tidy_pair(run), schema)


def with_repeats(docs: DataFrame, units, resolver: Resolver, make: Maker, schema: StructType | str, part_bytes: int = PART_BYTES) -> DataFrame:
    """The whole course: ``make`` gets every row with the spans (in symbols) that windows of smaller documents cover.

    Rows without an id take no part: they come through with no spans, in a narrow pass of their own.
    """
    schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    groups, buckets, shards = max(LEAST_GROUPS, size // GROUP_BYTES), max(LEAST_BUCKETS, size // BUCKET_BYTES), max(LEAST_SHARDS, size // SHARD_BYTES)
    rows = keyed(docs, groups)
    named = rows.filter("doc_id is not null")
    told = tell_shared(find_anchors(named, units, buckets, groups), groups, HOT_OWNERS)
    spans = resolve(collect_runs(named, told, units, buckets, shards, groups), resolver, units.length, groups, part_bytes)
    result = to_arrow_schema(schema)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            yield made(make, result, piece, [[]] * piece.num_rows)

    return finish(named, spans, make, schema).unionByName(rows.filter("doc_id is null").mapInArrow(tidy(untouched), schema))
