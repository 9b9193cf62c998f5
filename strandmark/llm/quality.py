"""Quality rules: word rules, then tokeniser fertility within bands per script (operator 5).

Two public vocabularies measure every text: characters a token under either, byte-fallback share and token entropy under the first.
The bands come from the corpus itself: for each script the quartiles of each figure over all texts that pass the word rules, and as
much room beyond them as several times their distance. So a band follows what is usual in a script, and refuses what is far from it.
"""

from __future__ import annotations

import base64
import os
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmark.llm.frames import map_rows, written

SYMBOLS = b"#*$%&|<>"
#: Scripts that have bands of their own; any other, and texts without letters, are "other".
SCRIPTS = {name: regex.compile(rf"\p{{{name}}}") for name in ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Hangul")}
ASCII, ASCII_LETTERS = bytes(range(128)), string.ascii_letters.encode()
#: What SentencePiece writes for a space.
SPACE_SIGN = "\u2581"
#: Figure -> (share of its median that the quartiles are apart at least, room in any case, has a lower bound, has an upper bound).
FIGURES = {
    "chars_per_token": (0.08, 0.0, True, True),
    "chars_per_multi_token": (0.08, 0.0, True, True),
    "byte_share": (0.0, 0.05, False, True),
    "token_entropy": (0.08, 0.0, True, False),
}
MEASURED = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "script string, n_tokens long, chars_per_token double, chars_per_multi_token double, byte_share double, token_entropy double"
)


class Vocabulary:
    """What a vocabulary makes of words, each by itself.

    Words are encoded together, a space between each two: no token holds a space but in front, so the tokens that begin with one tell
    the words apart. Words with white space beyond ASCII's, or with the sign that stands for a space, go alone.
    """

    def each(self, words: list[str]) -> list:
        plain = [w.isprintable() and SPACE_SIGN not in w for w in words]
        joined = words if all(plain) else [w for w, yes in zip(words, plain) if yes]
        ids = self.encoded(" ".join(joined)) if joined else np.empty(0, np.int64)
        at = np.flatnonzero(self.in_front[ids])
        if len(at) != len(joined):
            return [self.alone(w) for w in words]
        together = self.values(ids, at)
        if joined is words:
            return together
        together = iter(together)
        return [next(together) if yes else self.alone(w) for w, yes in zip(words, plain)]

    def alone(self, word: str) -> bytes | int:
        return self.values(self.encoded(word), np.zeros(1, np.int64))[0]


class WordPieces(Vocabulary):
    """word -> its ids as bytes under a SentencePiece vocabulary."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.vocab_size())])
        self.in_front = np.array([self.model.id_to_piece(i).startswith(SPACE_SIGN) for i in range(self.model.vocab_size())])

    def encoded(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text), "<u2")

    def values(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        data, cuts = ids.tobytes(), [*(2 * at).tolist(), 2 * len(ids)]
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]


class MultiTokens(Vocabulary):
    """word -> the number of its tokens under a byte-level vocabulary for many languages, with a space before it."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.count = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.in_front = np.zeros(max(ranks.values()) + 1, bool)
        self.in_front[[rank for token, rank in ranks.items() if token.startswith(b" ")]] = True

    def encoded(self, text: str) -> np.ndarray:
        return np.array(self.count(" " + text), np.int64)

    def values(self, ids: np.ndarray, at: np.ndarray) -> list[int]:
        return np.diff(at, append=len(ids)).tolist()


class WordTable:
    """word -> what each of some vocabularies makes of it, remembered up to a bound."""

    MOST, AT_ONCE = 400_000, 50_000

    def __init__(self, *vocabularies: Vocabulary):
        self.vocabularies = vocabularies
        self.known: dict[bytes, tuple] = {}

    def of(self, words: list[bytes]) -> Iterator[tuple]:
        for i in range(0, len(words), self.AT_ONCE):
            part = words[i : i + self.AT_ONCE]
            found = [*map(self.known.get, part)]
            if not all(found):
                if len(self.known) >= self.MOST:
                    self.known.clear()
                    found = [None] * len(part)
                new = [*{w for w, value in zip(part, found) if value is None}]
                texts = [w.decode() for w in new]
                self.known.update(zip(new, zip(*(v.each(texts) for v in self.vocabularies))))
                found = map(self.known.__getitem__, part)
            yield from found


@lru_cache(maxsize=1)
def word_table(path: str, multi_path: str) -> WordTable:
    return WordTable(WordPieces(path), MultiTokens(multi_path))


def repeated_words(words: list[bytes], n: int = 5) -> int:
    """Words in ``n``-word windows that occur twice or more, the first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(n))))
    if len(set(windows)) == len(windows):
        return 0
    first: dict[tuple, int] = {}
    marked = bytearray(len(words))
    for i, w in enumerate(windows):
        j = first.setdefault(w, i)
        if j != i:
            marked[j : j + n] = marked[i : i + n] = b"\1" * n
    return marked.count(1)


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


@lru_cache(maxsize=65_536)
def script_of(letter: str) -> str | None:
    """The one of ``SCRIPTS`` that a character belongs to."""
    return next((name for name, p in SCRIPTS.items() if p.match(letter)), None)


def dominant_script(text: str) -> str:
    """The script of most letters, the first of ``SCRIPTS`` if several have as many."""
    data = text.encode()
    counts = dict.fromkeys(SCRIPTS, 0) | {"Latin": len(data) - len(data.translate(None, ASCII_LETTERS))}
    for letter, n in Counter(data.translate(None, ASCII).decode()).items():
        script = script_of(letter)
        if script:
            counts[script] += n
    most = max(counts, key=counts.get)
    return most if counts[most] else "other"


def fertility(pieces: Iterable[bytes], chars: int, is_byte: np.ndarray) -> tuple[float, float, float, int]:
    """Characters a token, byte-fallback share, entropy in bits of the token distribution, tokens."""
    ids = np.frombuffer(b"".join(pieces), "<u2")
    if not len(ids):
        return 0.0, 0.0, 0.0, 0
    counts = np.bincount(ids) if len(ids) > 20_000 else np.unique(ids, return_counts=True)[1]
    counts = counts[counts > 0]
    share = counts / len(ids)
    return chars / len(ids), float(is_byte[ids].mean()), float(-(share * np.log2(share)).sum()) + 0.0, len(ids)


def measured(docs: DataFrame, path: str | None = None, multi_path: str | None = None) -> DataFrame:
    """Counts of the word rules, script and fertility figures of every row, in one narrow pass."""

    def make():
        from strandmark.llm.bpe import vocabulary

        os.environ["OMP_NUM_THREADS"] = "1"
        known = word_table(path or vocabulary("piece_bpe_32k.model"), multi_path or vocabulary("byte_bpe_multi_50k.tiktoken"))
        is_byte = known.vocabularies[0].is_byte

        def one(text: str | None) -> tuple:
            text = text or ""
            data = text.encode()
            words = data.split()
            chars = len(text) - len(data) + sum(map(len, words))
            repeats = repeated_words(words)
            failed = len(words) < 10 or 100 * repeats > 20 * len(words)
            pieces, multi = zip(*known.of(words)) if words else ((), ())
            per_token, byte_share, entropy, tokens = fertility(pieces, chars, is_byte)
            per_multi = chars / max(1, sum(multi))
            symbols = len(data) - len(data.translate(None, SYMBOLS))
            return len(words), chars, symbols, repeated_lines(data), repeats, failed, dominant_script(text), tokens, per_token, per_multi, byte_share, entropy

        names = [x.split()[0] for x in MEASURED.split(", ")][1:]

        def work(rows: dict) -> dict:
            return {"doc_id": rows["doc_id"]} | dict(zip(names, map(list, zip(*map(one, rows["text"]), strict=True)), strict=True))

        return work

    return map_rows(docs.select("doc_id", "text"), make, MEASURED)


def fit_bands(figures: DataFrame, spread: float = 2.0, least_tokens: int = 128) -> DataFrame:
    """script, and low_ and high_ of each figure: its quartiles and ``spread`` times their distance beyond.

    From all rows of ``figures`` that pass the word rules and have ``least_tokens`` tokens. One small sketch a script and
    figure moves, so a script with nearly all rows does no harm; there are at most ten rows.
    """
    quartiles = lambda f: F.percentile_approx(f, [0.25, 0.5, 0.75], 10_000).alias(f)
    found = figures.filter(~F.col("base_failed") & (F.col("n_tokens") >= least_tokens)).groupBy("script").agg(*map(quartiles, FIGURES))

    def bounds(f: str, share: float, room: float, lower: bool, upper: bool) -> list[Column]:
        q = lambda i: F.col(f)[i]
        apart = F.greatest(q(2) - q(0), share * q(1))
        return [F.lit(float("-inf")) if not lower else q(0) - spread * apart - room, F.lit(float("inf")) if not upper else q(2) + spread * apart + room]

    return found.select("script", *(c.alias(f"{side}_{f}") for f, how in FIGURES.items() for side, c in zip(("low", "high"), bounds(f, *how))))


def judged(figures: DataFrame, bands: DataFrame, least_tokens: int = 128) -> DataFrame:
    """Adds ``kept``: the word rules hold, and with ``least_tokens`` tokens or more every figure lies within the band of the script.

    A script without a band has nothing to be far from, and shorter texts have figures by chance: there the word rules decide.
    """
    within = F.lit(True)
    for f in FIGURES:
        within &= F.coalesce(F.col(f).between(F.col(f"low_{f}"), F.col(f"high_{f}")), F.lit(True))
    kept = ~F.col("base_failed") & ((F.col("n_tokens") < least_tokens) | within)
    joined = figures.join(F.broadcast(bands), "script", "left")  # at most ten rows
    return joined.withColumn("kept", kept).select(*figures.columns[:7], "kept", *figures.columns[7:])


def score_quality(docs: DataFrame, spread: float = 2.0, least_tokens: int = 128, path: str | None = None, multi_path: str | None = None) -> DataFrame:
    """Counts, figures and verdicts of every row; other columns, also of clashing names, aren't read, repeated rows stay rows.

    Words are runs without ASCII white space. Null and empty texts have no words: counts 0, base_failed true, kept
    false, fertility figures 0. A figure on a bound is within it. A very long text is held by its own task alone, with arrays in
    proportion to it. An empty table has no bands and gives no rows. Texts are read once; their figures, a small row each,
    are written, and the bands are fitted over all of them.
    """
    figures = written(measured(docs, path, multi_path), "quality")
    return judged(figures, fit_bands(figures, spread, least_tokens), least_tokens)
