"""Operators 1, 4, 5, 6 and 7 against brute force, on the smallest tables and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from strandmark.llm import decontaminate, language, packing, quality, queries, token_counts
from strandmark.llm.bpe import piece_ids, vocabulary
from strandmark.llm.frames import table

TOK = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ODD = [
    (1, None, "en", "s", 0),
    (2, "", None, "s", 0),
    (3, " \n\t ", "en", None, 3),
    (4, "a<|endoftext|>b <|startoftext|>", "en", "s", 3),
    (5, "É́tude ΣΑΣ İstanbul ſ ß 東京  x y 😀 'SS don'T", "fr", "s", 3),
    (5, "same id", "en", "s", 3),
    (5, "same id", "en", "s", 3),
    (None, "12345 $$$ ***", "de", "s", 3),
    (6, "word " * 30_000 + "end" * 40_000, "en", "s", 3),
]


def ids(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, 1, "x") for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, _rank string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


def test_token_counts(spark, sf_dir, odd, empty):
    for df in (table(spark, sf_dir, "documents"), odd):
        got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(df, chunk_bytes=1 << 10).collect())
        want = sorted((d or 0, len((t or "").encode()), n := len(ids(t)), n > 2048) for d, t in df.select("doc_id", "text").collect())
        assert got == want
    assert token_counts.count_tokens(empty).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("abT'sé \n\t1<|>endoftx́ß東 Σ\x1c"), max_size=60), st.integers(1, 7))
def test_state_maps_compose(text, size):
    transducer = token_counts.TokenCounter(piece_ids(vocabulary()))
    assert transducer.tokens(text.encode(), size) == len(ids(text))
    data = text.encode()
    a, b, c = (transducer.chunk(x) for x in (data[:size], data[size : 2 * size], data[2 * size :]))
    assert transducer.compose(transducer.compose(a, b), c) == transducer.compose(a, transducer.compose(b, c))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_piece_ids(text):
    assert piece_ids(vocabulary()).text(text) == b"".join(i.to_bytes(4, "little") for i in ids(text))


def check_packing(rows, docs, capacity=4096):
    want = Counter()
    for doc, text in docs:
        data = b"".join(i.to_bytes(4, "little") for i in [*ids(text), 1])
        for k, i in enumerate(range(0, len(data), 4 * capacity)):
            cut = data[i : i + 4 * capacity]
            want[(doc, k, i // 4, len(cut) // 4, zlib.crc32(cut))] += 1
    assert Counter(tuple(r[:5]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by), -(-sum(r["length"] for r in rows) // capacity)


def test_packing(spark, sf_dir, odd, empty):
    docs = table(spark, sf_dir, "documents")
    used, least = check_packing(packing.pack(docs).collect(), docs.select("doc_id", "text").collect())
    assert used <= least + 2
    check_packing(packing.pack(odd, 64).collect(), [r[:2] for r in ODD], 64)
    assert packing.pack(empty).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.sampled_from([7, 12, 40, 1000]).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_plans_hold_all_items(case):
    capacity, items = case
    plans = packing.plan_packing(Counter(items), capacity)
    assert all(sum(p) <= capacity and n > 0 for p, n in plans)
    assert sum((Counter({x: p.count(x) * n for x in set(p)}) for p, n in plans), Counter()) == Counter(items)


def least_bins(items, capacity):
    """Exact, by branch and bound; for tiny cases."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
            go(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
        go(i + 1, [*rooms, capacity - items[i]])

    go(0, [])
    return best[0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9))
def test_reduction_keeps_an_optimum(items):
    """What dominance fixes, with an exact packing of the rest, is as good as an exact packing of all."""
    fixed, rest = packing.reduce_by_dominance(packing.Stock(Counter(items), 12), 12)
    left = [x for x in rest.sizes for _ in range(rest.count[x])]
    assert sum(n for _, n in fixed) + least_bins(left, 12) == least_bins(items, 12)


def test_equal_pairs_are_one_plan():
    assert packing.plan_packing({3000: 1000, 1000: 1000}, 4096) == [((3000, 1000), 1000)]
    assert packing.plan_packing({3000: 7, 1000: 9}, 4096)[0] == ((3000, 1000), 7)


def test_any_number_of_runs(spark, monkeypatch):
    """As many runs as pieces, and ranges of ranks that many runs share."""
    monkeypatch.setattr(packing, "RUN_RANKS", 4)
    monkeypatch.setattr(packing, "plan_packing", lambda counts, capacity: [((x,), 1) for x, n in counts.items() for _ in range(n)])
    rows = [(k, "a " * (k % 3)) for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    placed = packing.pack(docs, 7).collect()
    check_packing(placed, rows, 7)
    assert len({r["sequence_id"] for r in placed}) == len(placed) > 64 * 7


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    marked = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(marked) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), failed


def brute_figures(text, pieces, multi):
    """script, tokens and the four figures by the libraries' plain calls."""
    import math
    import unicodedata

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    ids = [i for w in words for i in pieces.encode(w)]
    chars = sum(map(len, words))
    entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values()) if ids else 0.0
    script = "Latin" if any("LATIN" in unicodedata.name(c, "") for c in text or "") else "other"
    many = sum(len(multi.encode_ordinary(" " + w)) for w in words)
    return script, len(ids), chars / len(ids) if ids else 0.0, chars / max(1, many), sum(map(pieces.is_byte, ids)) / max(1, len(ids)), entropy


def test_words_encoded_together_are_as_alone():
    """Every printable character and odd ones, alone and within words; and few calls of the library for many words."""
    words = [c for c in map(chr, range(33, 0x3100)) if not c.isspace()] + ["a\u00a0b", "\u2003", "\u2581", "x\u2581y", "a\u200db", "'tis", "it's", "</s>", "<0x41>", "\ufeffx", "\U0001f600", "\ufe0f", "\x00", "´", "x¨"]
    words = [w.encode() for w in [*words, *(f"a{w}1" for w in words), *(f"{w}." for w in words)] if len(w.encode().split()) == 1 and w.encode().split()[0] == w.encode()]
    known = quality.WordTable(quality.WordPieces(public_tokenizers.path("piece_bpe_32k.model")), quality.MultiTokens(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    want, calls = [tuple(v.alone(w.decode()) for v in known.vocabularies) for w in words], []
    for v in known.vocabularies:
        v.encoded = lambda text, whole=v.encoded: (calls.append(1), whole(text))[1]
    got = [found for i in range(0, len(words), 100) for found in known.of(words[i : i + 100])]
    assert got == want and len(calls) < len(words) / 4
    known.known.clear()
    known.MOST, known.AT_ONCE = 50, 20
    assert [*known.of(words[::-1])] == want[::-1] and len(known.known) <= 70


def test_dominant_script():
    for text in ("", "1 !", "ab я", "я ab яя", "漢字 ひ", "ひひ 漢", "ªº я", "ά ά", "ab яя", "한 a"):
        counts = {name: len(p.findall(text)) for name, p in quality.SCRIPTS.items()}
        most = max(counts, key=counts.get)
        assert quality.dominant_script(text) == (most if counts[most] else "other"), text


def test_quality(spark, sf_dir, odd, empty):
    import base64
    import math

    import sentencepiece
    import tiktoken

    for df in (table(spark, sf_dir, "documents"), odd):
        rows = quality.score_quality(df).collect()
        assert Counter((r["doc_id"], *r[1:7]) for r in rows) == Counter((d, *brute_quality(t)) for d, t in df.select("doc_id", "text").collect())
        assert not any(r["kept"] and r["base_failed"] for r in rows)
    assert quality.score_quality(empty).collect() == []

    # figures, bands and verdicts of the whole table
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    multi = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    junk = [" ".join(f"w{i * j % 89}###$$$ an%%%" for i in range(90)) for j in (3, 5, 7)] + [" ".join(chr(0x13000 + i * i % 900) + "a" for i in range(80)), " ".join("a" * (i % 97 + 3) for i in range(97))]
    every = docs.unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(junk)], docs.schema))
    texts = dict(map(tuple, every.collect()))
    brute = {d: (brute_quality(t)[-1], *brute_figures(t, pieces, multi)) for d, t in texts.items()}
    used = [b[3:] for b in brute.values() if not b[0] and b[1] == "Latin" and b[2] >= 128]
    low, high = [], []
    for k, (share, room, has_low, has_high) in enumerate(quality.FIGURES.values()):
        v = sorted(u[k] for u in used)
        q1, q2, q3 = (v[max(0, math.ceil(x * len(v)) - 1)] for x in (0.25, 0.5, 0.75))
        apart = max(q3 - q1, share * q2)
        low.append(q1 - 2 * apart - room if has_low else -math.inf)
        high.append(q3 + 2 * apart + room if has_high else math.inf)
    got = {r["doc_id"]: r for r in quality.score_quality(every).collect()}
    assert got.keys() == brute.keys()
    for d, (failed, script, tokens, *figures) in brute.items():
        r = got[d]
        assert (r["script"], r["n_tokens"]) == (script, tokens), d
        assert all(abs(r[f] - x) < 1e-9 for f, x in zip(quality.FIGURES, figures)), d
        inside = all(a <= x <= b for a, x, b in zip(low, figures, high))
        assert r["kept"] == (not failed and (tokens < 128 or script != "Latin" or inside)), d
    assert not any(got[10**6 + i]["kept"] for i in range(5))
    kept_share = sum(r["kept"] for d, r in got.items() if d < 10**6) / sum(not r["base_failed"] for d, r in got.items() if d < 10**6)
    assert 0.9 < kept_share < 1


def test_quality_bands(spark):
    """Each bound refuses what lies beyond it, and only in texts that are long enough and in scripts that have a band."""
    usual = {"chars_per_token": 2.0, "chars_per_multi_token": 2.0, "byte_share": 0.0, "token_entropy": 6.0}
    rows = [(i, 50, 100, 0, 0, 0, False, "Latin", 300, *(v + 0.01 * (i % 5) for v in usual.values())) for i in range(40)]
    changes = [("chars_per_token", 0.5, 300), ("chars_per_token", 5.0, 300), ("chars_per_multi_token", 0.5, 300), ("chars_per_multi_token", 5.0, 300), ("byte_share", 0.9, 300), ("token_entropy", 1.0, 300), ("token_entropy", 1.0, 100)]
    odd_rows = [(100 + k, 50, 100, 0, 0, 0, False, "Latin", n, *(usual | {f: v}).values()) for k, (f, v, n) in enumerate(changes)]
    alone = [(200, 50, 100, 0, 0, 0, False, "Greek", 100, 9.0, 9.0, 0.9, 0.1), (201, 50, 100, 0, 0, 0, True, "Latin", 300, *usual.values())]
    figures = spark.createDataFrame(rows + odd_rows + alone, quality.MEASURED)
    got = {r["doc_id"]: r["kept"] for r in quality.judged(figures, quality.fit_bands(figures)).collect()}
    assert [d for d, kept in sorted(got.items()) if not kept] == [*range(100, 106), 201]


def brute_items(text, bench, window=13):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = split(text), set(), set()
    for item, t in bench:
        p = split(t)
        m = min(window, len(p))
        for i in range(len(p) - m + 1) if m else ():
            for j in range(len(w) - m + 1):
                if w[j : j + m] == p[i : i + m]:
                    hit |= {*range(j, j + m)}
                    found.add(str(item))
    joined = ",".join(sorted(found))
    return len(w), len(hit), len(found), hashlib.sha256(joined.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def test_decontamination(spark, sf_dir, odd, empty):
    bench = table(spark, sf_dir, "benchmark")
    docs = table(spark, sf_dir, "documents")
    first = bench.first()["text"]
    extra = spark.createDataFrame([(900, "x " + first.upper() + " y", "en", "s", 1), (901, "Uno-dos", "es", "s", 1), (902, "uno dos uno dos", "es", "s", 1)], docs.schema)
    small = bench.limit(6).unionByName(spark.createDataFrame([(77, "Uno, dos"), (78, None), (79, "..."), (77, "uno dos")], bench.schema))
    some = docs.orderBy("doc_id").limit(15).unionByName(extra).unionByName(odd.select(docs.columns).filter("doc_id is null or doc_id < 6"))
    items = [tuple(r) for r in small.collect()]
    want = Counter((d, *brute_items(t, items)) for d, t in some.select("doc_id", "text").collect())
    for most in (1 << 20, 100):  # at once, and in parts
        assert Counter(map(tuple, decontaminate.find_items(some, small, max_bytes=most).collect())) == want
        left = decontaminate.drop_contaminated(some, small, max_bytes=most)
        assert left.columns == some.columns
        assert {r["doc_id"] for r in left.collect()} == {k[0] for k in want if not k[-1]}
    assert decontaminate.find_items(empty, small).collect() == []
    assert all(r["n_hit"] == 0 for r in decontaminate.find_items(some, small.filter("false")).collect())


def test_language(spark, sf_dir, odd, empty):
    rows = queries.op4_language_id(spark, sf_dir).collect()
    lang = dict(table(spark, sf_dir, "documents").select("doc_id", "lang").collect())
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    model = language.train(table(spark, sf_dir, "documents"))
    got = [(r["doc_id"], r["lang_pred"]) for r in language.identify(odd, model).collect()]
    assert len(got) == len(ODD) and all(x == "und" for d, x in got if d in (1, 2, 3, None))
    assert language.keep_identified(odd, model, 0.0).columns == odd.columns
    assert language.identify(empty, model).collect() == []
    assert {r["lang_pred"] for r in language.identify(odd, language.train(empty)).collect()} == {"und"}
    assert len(model.score("zzqqx")) == 4


def brute_languages(rows, top_words, top_grams, added=0.5):
    """text -> (language, score) from (doc_id, lang, text) rows: the method in plain loops."""
    import math
    import unicodedata

    def split(text):
        return "".join(c if (c.isascii() and c.isalpha()) or (not c.isascii() and unicodedata.category(c)[0] in "LM") else " " for c in (text or "").lower()).split(" ")

    words, grams = {}, {}
    for d, lang, text in rows:
        if lang is not None and text is not None and (d is None or zlib.crc32(str(d).encode()) % 5):
            for w in filter(None, split(text)):
                words.setdefault(w, Counter())[lang] += 1
                for n in range(1, 5):
                    for i in range(len(w) + 3 - n):
                        grams.setdefault(f" {w} "[i : i + n], Counter())[lang] += 1
    langs = sorted({x for c in words.values() for x in c})
    totals = {x: sum(c[x] for c in words.values()) for x in langs}

    def most(found, top):
        # the best place that a string has among those of a language, equal counts sharing the last one
        ordered = {x: sorted(c[x] for c in found.values() if c[x]) for x in langs}
        from bisect import bisect_left

        rank = lambda c: min(len(ordered[x]) - bisect_left(ordered[x], n) for x, n in c.items())
        return {s: found[s] for s in sorted(found, key=lambda s: (rank(found[s]), -found[s].total(), s))[:top]}

    words, grams = most(words, top_words), most(grams, top_grams)
    sums = {(n, x): sum(c[x] for g, c in grams.items() if len(g) == n) for n in range(1, 5) for x in langs}
    kinds = Counter(map(len, grams))

    def log(word, x):
        unseen = added / (totals[x] + added * (len(words) + 1))
        if word in words:
            return math.log((words[word][x] + added) / (totals[x] + added * (len(words) + 1)))
        padded, out = f" {word} ", math.log(unseen)
        while padded:
            n = next((n for n in range(4, 0, -1) if len(padded) >= n and padded[:n] in grams), 0)
            if n:
                out += math.log((grams[padded[:n]][x] + added) / (sums[n, x] + added * kinds[n]))
            padded = padded[max(n, 1) :]
        return out

    def predict(text):
        found = [w for w in split(text) if w]
        if not found:
            return "und", 0.0
        counts = Counter(found)
        by = {x: sum(n * log(w, x) for w, n in counts.items()) / math.sqrt(len(found)) for x in langs}
        best = max(langs, key=by.get)
        return best, 1 / sum(math.exp(v - by[best]) for v in by.values())

    return predict


def test_language_brute_force(spark, sf_dir, odd):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    extra = spark.createDataFrame([(9001, None, "«bonjour» — l’été… zzqx ñandú 東京"), (9002, "xx", "qzq qzq «qzq» wwv"), (9003, None, None), (9004, None, "123 ...")], docs.schema)
    every = docs.unionByName(extra)
    rows = [tuple(r) for r in every.collect()]
    model = language.train(every, top_words=400, top_grams=900)
    predict = brute_languages(rows, 400, 900)
    for r in language.identify(every, model).collect():
        lang, score = predict(next(t for d, _, t in rows if d == r["doc_id"]))
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-6, r


def test_language_with_one_short_document(spark, sf_dir):
    """A language of a single short document takes nothing from the others, and keeps its own words under a small bound."""
    docs = table(spark, sf_dir, "documents")
    own = "zorblat quimby xanthu wobble frindle okkapo zuzu blent marv grool"
    rare = next(d for d in range(10**9, 10**9 + 99) if zlib.crc32(str(d).encode()) % 5)
    all_docs = docs.unionByName(spark.createDataFrame([(rare, own, "qq", "s", len(own))], docs.schema))
    lang = dict(docs.select("doc_id", "lang").collect())
    model = language.train(all_docs)
    rows = language.identify(all_docs, model).collect()
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["doc_id"] != rare) >= 0.95 * len(lang)
    assert [r["lang_pred"] for r in rows if r["doc_id"] == rare] == ["qq"]
    few = language.train(all_docs, top_words=100)
    assert len(few.words) == 100 and set(own.split()) <= few.words.keys()
