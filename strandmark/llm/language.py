"""Language identification by known words, backing off to character n-grams (operator 4)."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmark.llm.frames import map_rows, slices, tidy, written

LETTER = regex.compile(r"\p{L}")
#: Bytes that separate words: ASCII but its letters. Of other characters letters and their marks stay, see ``lower_words``.
SPLIT = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LONGEST_GRAM = 4
#: What additive smoothing adds to the count of every outcome.
ADDED = 0.5


class Model:
    """Log frequencies by language: known words, and n-grams of 1 to 4 characters for the rest."""

    def __init__(self, langs: list[str], words: dict[str, list[int]], grams: dict[str, list[int]], totals: list[int]):
        self.langs = langs
        sums, kinds = np.zeros((LONGEST_GRAM + 1, len(langs))), Counter(map(len, grams))
        for g, c in grams.items():
            sums[len(g)] += c
        # additive smoothing over all outcomes: the known words and one for the rest; the known n-grams of one length
        logs = lambda counts, total, outcomes: tuple(np.log((np.array(counts, float) + ADDED) / (total + ADDED * outcomes)).tolist())
        self.words = {w: logs(c, np.array(totals, float), len(words) + 1) for w, c in words.items()}
        self.unknown = logs([0] * len(langs), np.array(totals, float), len(words) + 1)
        self.grams = {g: logs(c, sums[len(g)], kinds[len(g)]) for g, c in grams.items()}

    def score(self, word: str) -> tuple[float, ...]:
        """Log probability by language: of a known word its own; of an unknown one that of any unknown word, times those of
        the n-grams that spell it, read left to right, each time the longest known. So all words are on one scale. Characters in no
        known n-gram tell nothing."""
        known = self.words.get(word)
        if known is not None:
            return known
        padded, at, read, get = f" {word} ", 0, [self.unknown], self.grams.get
        end = len(padded)
        while at < end:
            for n in range(min(LONGEST_GRAM, end - at), 0, -1):
                logs = get(padded[at : at + n])
                if logs is not None:
                    read.append(logs)
                    break
            else:
                n = 1
            at += n
        return tuple(map(sum, zip(*read)))


class Scores(dict):
    """word (bytes) -> row in a matrix of scores; bounded."""

    MOST = 100_000

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.matrix = np.zeros((self.MOST, len(model.langs)))

    def __missing__(self, word: bytes) -> int:
        row = self[word] = len(self)
        self.matrix[row] = self.model.score(word.decode())
        return row

    def of(self, words: list[bytes]) -> np.ndarray:
        total = np.zeros(self.matrix.shape[1])
        for i in range(0, len(words), self.MOST // 2):  # a part's words always fit
            part = words[i : i + self.MOST // 2]
            if len(self) + len(part) > self.MOST:
                self.clear()
            total += self.matrix[[*map(self.__getitem__, part)]].sum(axis=0)
        return total


@lru_cache(maxsize=1 << 14)
def separates(character: str) -> bool:
    """Whether a character outside ASCII is neither a letter nor a mark on one."""
    return unicodedata.category(character)[0] not in "LM"


def lower_words(text: str) -> list[bytes]:
    """Runs of letters, in lower case."""
    text = text.lower()
    if not text.isascii():
        for c in {*text}:
            if c > "\x7f" and separates(c):
                text = text.replace(c, " ")
    return text.encode().translate(SPLIT).split()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, sample_rows: int = 20_000, top_words: int = 30_000, top_grams: int = 40_000) -> Model:
    """Learns from rows with a language outside the held-out fifth.

    ``sample_rows`` bounds the training rows (those with the least hash of doc_id); ``top_words`` and ``top_grams`` bound
    the model. Words and n-grams enter it by their best rank within a language, so that each language has its share whatever
    its part of the sample. Whole texts of the sample are counted in Spark; the bounded tables come to the driver.
    """
    spark = docs.sparkSession
    sample = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang")
    ids = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    used = docs.select("doc_id", "lang", "text").join(F.broadcast(ids.select("doc_id").distinct()), "doc_id", "left_semi").filter(F.col("lang").isNotNull())

    def counted(batches):
        tally: Counter = Counter()

        def flush():
            keys, n = list(tally), list(tally.values())
            tally.clear()
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1].decode() for k in keys], pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])

        for piece in slices(batches):
            for lang, text in zip(piece.column("lang").to_pylist(), piece.column("text").to_pylist()):
                tally.update((lang, w) for w in lower_words(text or ""))
                if len(tally) > 100_000:
                    yield flush()
        if tally:
            yield flush()

    tokens = used.select("lang", "text").mapInArrow(tidy(counted), "lang string, word string, n long")
    counts = tokens.groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = written(counts, "language-words")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    padded = F.concat(F.lit(" "), F.col("word"), F.lit(" "))
    starts = lambda n: F.when(F.length(padded) >= n, F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substr(padded, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    grams = counts.select("lang", "n", F.explode(F.concat(*(starts(n) for n in range(1, LONGEST_GRAM + 1)))).alias("word")).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    grams = written(grams, "language-grams")

    def most(df: DataFrame, top: int) -> dict[str, list[int]]:
        # rank: how many of the language are as frequent or more; from the few distinct counts, no language is sorted in one task
        as_frequent = Window.partitionBy("lang").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
        ranks = df.groupBy("lang", "n").agg(F.count("*").alias("same")).withColumn("rank", F.sum("same").over(as_frequent)).drop("same")
        ranked = df.join(F.broadcast(ranks), ["lang", "n"])
        per = ranked.groupBy("word").agg(F.min("rank").alias("rank"), F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
        return {r["word"]: [r["by"].get(x, 0) for x in langs] for r in per.orderBy("rank", F.desc("all"), "word").limit(top).collect()}

    return Model(langs, most(counts, top_words), most(grams, top_grams), [totals[x] for x in langs])


def predictor(model: Model) -> Callable[[str | None], tuple[str, float]]:
    """text -> (language, probability at the mean log frequency, sharpened by the square root of the words)."""
    scores = Scores(model)

    def predict(text: str | None) -> tuple[str, float]:
        if not model.langs or not text or LETTER.search(text) is None:
            return "und", 0.0
        words = lower_words(text)
        if not words:
            return "und", 0.0
        logs = scores.of(words) / math.sqrt(len(words))
        best = int(logs.argmax())
        return model.langs[best], float(1 / np.exp(logs - logs[best]).sum())

    return predict


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from its whole text alone; one narrow pass.

    Null texts, texts without a letter and any text under a model without languages are ``und`` with score 0. Ties go to
    the language first in order. Repeated rows stay rows; other columns, also of clashing names, aren't read; a null doc_id isn't
    held out; a very long text is held by its own task alone; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        predict = predictor(shared.value)

        def work(rows: dict) -> dict:
            lang, score = zip(*map(predict, rows["text"]), strict=True)
            return {"doc_id": rows["doc_id"], "held_out": rows["held_out"], "lang_pred": list(lang), "score": list(score)}

        return work

    return map_rows(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), make, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with at least ``least_score``.

    Null texts, texts without letters and, under a model without languages, all texts go. The text alone is judged: null or
    repeated ids, repeated rows and columns of any name come through as they are. Ties are decided as in ``identify``. A very long
    text is held by its own task alone; an empty table gives no rows. One narrow pass.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        predict = predictor(shared.value)
        for piece in slices(batches):
            found = map(predict, piece.column(piece.schema.get_field_index("text")).to_pylist())
            yield piece.filter(pa.array([lang != "und" and score >= least_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
