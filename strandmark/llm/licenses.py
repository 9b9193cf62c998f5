"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above (operator 3)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmark.llm.frames import map_rows, slices, written
from strandmark.llm.license_texts import FOREIGN, GNU, SHORT, TELLING, TEXTS, statements

LICENSE_FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[a-z]+)?$"
TERM = regex.compile(r"[a-z0-9]+(?:\.[0-9]+)?")
#: Lines that are read as one header, from each line on.
HEADER_LINES = (1, 2, 3, 4, 6, 8, 12, 16, 24)
#: The share of files that a term outside the templates counts as being in, and the least share of any term: weights don't
#: grow with the number of files.
OTHER_SHARE, LEAST_SHARE = 0.05, 1e-4
FOUND = "path string, license string, score double, whole_license string, whole_score double"


#: A tag, and what stands in its expression.
TAG, TOKEN = regex.compile(r"SPDX-License-Identifier:(.*)", regex.I), regex.compile(r"[A-Za-z0-9.+-]*[A-Za-z0-9+]|\S")
KNOWN = {x.lower(): x for x in TEXTS} | {f"{x}{end}".lower(): x for x in GNU for end in ("-only", "-or-later", "+")}


def tagged(line: str) -> str | None:
    """The expression of a line's tag: identifiers with AND, OR, WITH and brackets, known identifiers as the templates name them, others as they
    are; it ends where it can't go on, as before a comment's end. None without a tag."""
    found = TAG.search(line)
    if not found:
        return None
    out, depth, whole = [], 0, 0  # whole: what is an expression so far
    for token in TOKEN.findall(found[1]):
        operand = not out or out[-1] in ("AND", "OR", "WITH", "(")
        if operand and token == "(":
            depth += 1
            out.append(token)
            continue
        if operand and token[0].isalnum():
            out.append(KNOWN.get(token.lower(), token))
        elif not operand and token == ")" and depth:
            depth -= 1
            out.append(token)
        elif not operand and token.upper() in ("AND", "OR", "WITH"):
            out.append(token.upper())
            continue
        else:
            break
        whole = whole if depth else len(out)
    return " ".join(out[:whole]).replace("( ", "(").replace(" )", ")") or None


def needed(spdx: str, terms: Counter) -> set[str]:
    """Terms of a wording without which a passage isn't about its licence: those that tell it from its relatives."""
    return {*TELLING.get(spdx, ()), *(TERM.findall(spdx.lower()) if terms.total() <= SHORT else ())} & terms.keys()


def idf(files_with: int, files: int) -> float:
    return -math.log(max((1 + files_with) / (1 + files), LEAST_SHARE)) + 1


class Cosine:
    """Inverted index over the terms of the templates, each with the weight that its share of all files gives it."""

    def __init__(self, document_frequency: dict[str, int], documents: int):
        wordings = [(spdx, Counter(TERM.findall(text.lower()))) for spdx, text in statements()]
        self.idf = {t: idf(document_frequency.get(t, 0), documents) for _, terms in wordings for t in terms}
        self.other = -math.log(OTHER_SHARE) + 1
        self.index: dict[str, list[tuple[int, float]]] = {}
        self.names = [spdx for spdx, _ in wordings]
        self.needed = [needed(spdx, terms) for spdx, terms in wordings]
        for k, (_, terms) in enumerate(wordings):
            weights = {t: n * self.idf[t] for t, n in terms.items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            for t, w in weights.items():
                self.index.setdefault(t, []).append((k, w / norm))

    def telling(self, least: float) -> set[str]:
        """Terms of which a text needs one to reach ``least``: the rarest, until what is left of each template is too light."""
        left, out = [1.0] * len(self.names), set()
        for t in sorted(self.index, key=lambda t: (-self.idf[t], t)):
            if any(left[k] >= least**2 for k, _ in self.index[t]):
                out.add(t)
                for k, v in self.index[t]:
                    left[k] -= v * v
        return out

    def best(self, terms: Counter) -> tuple[str | None, float]:
        """The closest template of those whose telling terms are there, and no relative's, and its cosine; ties to the first in alphabetical order."""
        dots: dict[int, float] = {}
        square = 0.0
        for t, n in terms.items():
            w = n * self.idf.get(t, self.other)
            square += w * w
            for k, v in self.index.get(t, ()):
                dots[k] = dots.get(k, 0.0) + w * v
        dots = {k: d for k, d in dots.items() if self.needed[k] <= terms.keys() and terms.keys().isdisjoint(FOREIGN.get(self.names[k], ()))}
        if not dots:
            return None, 0.0
        norm = math.sqrt(square)
        score, name = max(((d / norm, self.names[k]) for k, d in dots.items()), key=lambda x: (round(x[0], 12), [-ord(c) for c in x[1]]))
        return name, min(1.0, score)


def template_frequencies(files: DataFrame) -> tuple[dict[str, int], int]:
    """In how many of all files each term of the templates occurs, and the number of files."""
    terms = sorted({t for _, text in statements() for t in TERM.findall(text.lower())})

    def count(batches):
        n, seen = 0, Counter()
        wanted = set(terms)
        for piece in slices(batches):
            for text in piece.column(0).to_pylist():
                n += 1
                seen.update(wanted.intersection(TERM.findall((text or "").lower())))
        keys = ["", *seen]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n, *seen.values()], pa.int64())], ["term", "n"])

    rows = files.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    return found, found.pop("", 0)


def headers(text: str, telling: set[str]) -> Iterator[Counter]:
    """Terms of the passages that may declare a licence: from each line with a telling term on, that line and more of those below it,
    joined, as headers are wrapped. Comment marks aren't terms."""
    lines = [Counter(TERM.findall(line)) for line in text.split("\n")]
    lines = [c for c in lines if c]
    for i, first in enumerate(lines):
        if telling.isdisjoint(first):
            continue
        passage, have = Counter(), 0
        for n in HEADER_LINES:
            if i + have >= len(lines):
                break
            for c in lines[i + have : i + n]:
                passage.update(c)
            have = n
            yield passage


def declared(files: DataFrame, cosine: Cosine, least: float, kept: str) -> DataFrame:
    """The closest template of any passage of a file that can reach ``least``, and of the file as a whole; ``kept`` is the type of
    a further column."""
    shared = files.sparkSession.sparkContext.broadcast(cosine)

    def make():
        c = shared.value
        telling = c.telling(least)

        def one(text: str | None) -> tuple:
            tags = [x for x in map(tagged, (text or "").split("\n")) if x] if TAG.search(text or "") else []
            low = TAG.sub("", text or "").lower()
            best, total = (None, 0.0), Counter(TERM.findall(low))
            if tags:
                return tags[0], 1.0, *c.best(total)
            if telling.isdisjoint(total):
                return *best, *best
            for passage in headers(low, telling):
                best = max(best, c.best(passage), key=lambda x: x[1])
            return *best, *c.best(total)

        def work(rows: dict) -> dict:
            cols = zip(*map(one, rows["text"]), strict=True)
            return {"path": rows["path"], "kept": rows["kept"]} | dict(zip(("license", "score", "whole_license", "whole_score"), map(list, cols), strict=True))

        return work

    return map_rows(files, make, f"{FOUND}, kept {kept}")


def parents(path: Column) -> Column:
    """The directories above a path, nearest first, the root ("") last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def scan_licenses(files: DataFrame, least: float = 0.6, least_whole: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """path, license, score, origin ("file", "directory" or null) and from_directory of every row, and before them the columns ``keep``.

    A file's own licence is what its first SPDX tag says, known or not, with a score of 1; without a tag the template closest to one of its passages (a line, or several joined) with a cosine of ``least`` or
    more, if the passage has the terms that tell that licence from its relatives. Licence files (by name, or by a whole text at ``least_whole``) give their directory its licence: the best score, ties by
    name. Files without one of their own take that of the nearest directory above that has one. Document frequencies of
    the templates' terms come from all rows; other terms have one weight. Passages that can reach neither threshold are
    passed over. Directories, not files, are joined with their ancestors, so a directory with most of the files costs one row
    there; the last join has directory keys whose hot ones AQE splits. Null and empty texts declare nothing; a null path has no
    directory; repeated rows stay rows; an empty table gives no rows; columns that aren't kept aren't read, whatever their names, and
    kept ones shouldn't be named like the result's. A very long text is held by its own task alone, with its terms by line.
    """
    keep = keep or []
    files = files.select("path", "text", F.struct(F.lit(0).alias("_"), *keep).alias("kept"))
    frequencies, n = template_frequencies(files)
    own = declared(files, Cosine(frequencies, n), min(least, least_whole), files.schema["kept"].dataType.simpleString())
    by_whole = F.col("whole_score") >= least_whole
    named = F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False)) & (F.greatest("score", "whole_score") >= least_whole)
    sure = F.col("score") >= least
    own = own.select(
        "kept",
        "path",
        F.when(sure, F.col("license")).alias("license"),
        F.round("score", 6).alias("score"),
        F.element_at(parents(F.col("path")), 1).alias("directory"),
        F.when(by_whole, F.col("whole_license")).when(named, F.col("license")).alias("_given"),
        F.greatest("score", "whole_score").alias("_strength"),
    )
    own = written(own, "licenses")
    given = own.filter("_given is not null and directory is not null").groupBy("directory").agg(F.min(F.struct((-F.col("_strength")).alias("s"), "_given")).alias("g")).select("directory", F.col("g._given").alias("_given"))
    above = own.filter("directory is not null").select("directory").distinct().withColumn("_up", F.explode(F.concat(F.array("directory"), F.when(F.col("directory") == "", F.array().cast("array<string>")).otherwise(parents(F.col("directory"))))))
    above = above.withColumn("_depth", F.length("_up"))
    nearest = above.join(given.withColumnRenamed("directory", "_up"), "_up").groupBy("directory").agg(F.max_by(F.struct("_up", "_given"), "_depth").alias("_from"))
    joined = own.join(nearest, "directory", "left")
    inherits = F.col("license").isNull() & F.col("_from").isNotNull()
    return joined.select(
        *(F.col(f"kept.{c}").alias(c) for c in keep),
        "path",
        F.coalesce("license", F.col("_from._given")).alias("license"),
        "score",
        F.when(F.col("license").isNotNull(), F.lit("file")).when(inherits, F.lit("directory")).alias("origin"),
        F.when(inherits, F.col("_from._up")).alias("from_directory"),
    )
