"""Filter interaction audit against plain counting."""

import random
from itertools import permutations

from strandmark.llm import filter_audit

WHITE = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in WHITE:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(docs, labels):
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, lang in docs:
        text = text or ""
        words = words_of(text)
        fails = {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text) else set()
        fails |= {"D"} if set(text) & set("#$%&*|") else set()
        fails |= {"E"} if i is not None and i > least[text] else set()
        rows.append((lang or "", fails, any(i == x is not None and q == 1 for x, q, _ in labels), any(i == x is not None and t == 1 for x, _, t in labels)))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        removed = {}
        for order in map("".join, permutations("ABCDE")):
            alive = own
            for step, c in enumerate(order, 1):
                lost = [r for r in alive if c in r[0]]
                gone = [r for r in own if r not in alive]
                alive = [r for r in alive if c not in r[0]]
                removed[c] = removed.get(c, 0) + len(lost)
                out[part, order, step] = [len(alive), len(lost), sum(c in r[0] for r in gone), sum(r[0] == {c} for r in own), sum(r[1] for r in lost), sum(r[2] for r in lost)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(removed[order[step - 1]])
    return out


def found(spark, docs, labels):
    df = filter_audit.audit(spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    rows = df.collect()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert len({(r["part"], r["filter_order"], r["step"]) for r in rows}) == len(rows)
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in rows}


def test_filter_audit(spark):
    rnd = random.Random(12)
    texts = [" ".join(rnd.choice(["a", "B", "c#", "dd", f"w{rnd.randrange(400)}"]) if rnd.random() < p else f"w{rnd.randrange(400)}" for _ in range(n)) for n in (0, 3, 150, 199, 200, 201, 260, 900) for p in (0, 0.03, 0.9)]
    texts += [None, "", " \n", "UP", "ÄÖÜ ß", "A" + "ä" * 30, "A" + "ä" * 40, "A€" * 20 + "€𝄞" * 700, "x y z", "A" * 3 + "a" * 97, "A" * 4 + "a" * 96, ("ab " * 3000)[:-1], "x" * 50_000]
    docs = [(rnd.randrange(60), rnd.choice(texts), rnd.choice(["de", "en", None, ""])) for _ in range(150)]
    docs += [(7, "same text", "de"), (7, "same text", "de"), (9, "same text", "en"), (None, "same text", "en"), (None, "alone", "fr"), (None, "alone", "fr")]
    docs += [(1000 + i, "copy", "de") for i in range(200)]
    labels = [(rnd.randrange(70), rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for _ in range(60)] + [(1150, 1, 1), (1150, 0, 0), (None, 1, 1)]
    assert found(spark, docs, labels) == brute(docs, labels)


def test_empty_and_further_columns(spark):
    assert found(spark, [], []) == {}
    docs = spark.createDataFrame([(1, "a #", "de", 5, 6, 7)], "doc_id long, text string, lang string, mask int, n int, `a.b` int")
    labels = spark.createDataFrame([(1, 1, 0, 3, "x")], "doc_id long, quality int, toxic int, n int, text string")
    rows = filter_audit.audit(docs, labels).filter("filter_order = 'DABCE'").orderBy("step").collect()
    assert [(r["removed"], r["good_lost"], r["redundant"]) for r in rows] == [(1, 1, 0), (0, 0, 1), (0, 0, 0), (0, 0, 0), (0, 0, 0)]


def test_long_texts_in_pieces(monkeypatch):
    rnd = random.Random(3)
    texts = [b"", b"  ", b"a" * 40, b" b" * 30, b"word " * 9, "öß x y \x0b z".encode()]
    texts += [bytes(rnd.choice(b"ab \n") for _ in range(rnd.randrange(60))) for _ in range(300)]
    for piece in (1, 2, 3, 7, 16, 1 << 20):
        monkeypatch.setattr(filter_audit, "PIECE", piece)
        assert [filter_audit.word_counts(t) for t in texts] == [(len(t.split()), len(set(t.split()))) for t in texts]
