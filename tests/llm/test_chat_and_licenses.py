"""Operators 2 and 3."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandmark.llm import chat, license_texts, licenses, queries
from strandmark.llm.frames import table

CONTROL_TEXT = st.lists(st.sampled_from([*"<|>[]/\\sINTSYé \n", "</s>", "[INST]", "<|end|>\n", "<<SYS>>", "<|image:0|>"]), max_size=15).map("".join)


@settings(max_examples=500, deadline=None)
@given(CONTROL_TEXT)
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert "<|" not in chat.escape(text) and "</s>" not in chat.escape(text) and "[/INST]" not in chat.escape(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(CONTROL_TEXT, st.lists(st.tuples(st.sampled_from(["text", "image", "audio", "document"]), CONTROL_TEXT), min_size=1, max_size=4)), max_size=4))
def test_round_trip(turns):
    f = chat.Flattener()
    want, n = [], 0
    for i, (role, parts) in enumerate(turns):
        f.turn(i, role, [{"type": k, "text": t, "ref": "r", "width": 20, "height": 28, "seconds": 1.5, "pages": 2} for k, t in parts])
        row = []
        for k, t in parts:
            row.append((k, t) if k == "text" else (k, n))
            n += k != "text"
        want.append((role, row))
    assert chat.parse("".join(f.out)) == want
    assert [a[4] for a in f.attachments] == [{"image": 4, "audio": 38, "document": 1024}[k] for _, p in turns for k, _ in p if k != "text"]


def test_query(spark, sf_dir):
    got = {r["conv_id"]: r for r in queries.op2_chat_format(spark, sf_dir).collect()}
    turns = {}
    for r in table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert got.keys() == turns.keys()
    for conv, said in turns.items():
        loss = "".join(t for role, t in said if role == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(said) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] >= sum(len(a) + len(b) for a, b in said)


def test_awkward_turns(spark):
    rows = [(1, 0, None, None, "x"), (1, 0, "user", "a", "x"), (1, 0, "user", "a", "x"), (None, 1, "assistant", "b", "x"), (2, None, "assistant", "", "x"), (3, 5, "assistant", "long " * 40_000, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_conversations(chat.text_parts(turns))
    got = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    assert got[1]["n_turns"] == 3 and got[None]["loss_chars"] == 1 and got[2]["loss_chars"] == 0 and got[3]["loss_chars"] == 200_000
    assert chat.format_conversations(chat.text_parts(turns.filter("false"))).collect() == []


def test_attachments(spark):
    rows = [(1, 0, "user", [("text", "see", None, None, None, None, None), ("image", None, "i.png", 29, 14, None, None), ("audio", None, "a.wav", None, None, 2.0, None), None]), (1, 1, "user", None)]
    made = chat.format_conversations(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")).first()
    assert made["formatted"].startswith("<|role|>user<|text|>see<|part|><|image:0|><|part|><|audio:1|>")
    assert [(a["kind"], a["ref"], a["tokens"], a["turn"]) for a in made["attachments"]] == [("image", "i.png", 3, 0), ("audio", "a.wav", 50, 0)]
    assert made["attachment_tokens"] == 53
    with pytest.raises(Exception, match="unknown type"):
        chat.Flattener().turn(0, "user", [{"type": "video"}])


def test_license_inheritance(spark):
    body = "plain words without any statement at all\n"
    rows = [
        ("a/LICENSE", "Released under the MIT License.", 1),
        ("a/b/c/code.py", body, 1),
        ("a/b/COPYING", body + "Licensed under the Apache License, Version 2.0.", 1),
        ("a/x.py", "This work is licensed under the GNU General Public License, version 3.\n" + body, 1),
        ("z/y.py", body, 1),
        ("a/b/c/code.py", body, 1),
        ("top.py", None, 1),
        (None, "Licensed under CC BY-NC 4.0.", 1),
        ("e", "", 1),
    ]
    files = spark.createDataFrame(rows, "path string, text string, score int")
    got = sorted((r["path"] or "", r["license"] or "", r["origin"] or "", r["from_directory"]) for r in licenses.scan_licenses(files).collect())
    assert ("a/LICENSE", "MIT", "file", None) in got
    assert got.count(("a/b/c/code.py", "Apache-2.0", "directory", "a/b")) == 2
    assert ("a/x.py", "GPL-3.0", "file", None) in got and ("z/y.py", "", "", None) in got
    assert ("", "CC-BY-NC-4.0", "file", None) in got and len(got) == len(rows)
    assert licenses.scan_licenses(files.filter("false")).collect() == []


def test_license_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    names = {"Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0"}
    for r in queries.op3_license_scan(spark, sf_dir).collect():
        want = {v for k, v in names.items() if k in docs[r["doc_id"]]}
        assert (r["license"] in want) if want else r["origin"] != "file", r


def brute_scan(files, least=0.6, least_whole=0.5):
    """(path, license, score, origin, from_directory) of each (path, text), by plain vectors and a walk up the directories."""
    import math
    import re
    from collections import Counter

    terms = lambda t: Counter(re.findall(r"[a-z0-9]+(?:\.[0-9]+)?", (t or "").lower()))
    wordings = [(x, terms(t)) for x, t in license_texts.statements()]
    known = {t for _, c in wordings for t in c}
    texts = [{*terms(t)} for _, t in files]
    weight = {t: 1 - math.log(max((1 + sum(t in x for x in texts)) / (1 + len(texts)), 1e-4)) for t in known}
    vector = lambda c: {t: n * weight.get(t, 1 - math.log(0.05)) for t, n in c.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    vectors = [(x, vector(c)) for x, c in wordings]

    words = lambda x, c: [*license_texts.TELLING.get(x, ()), *(terms(x) if sum(c.values()) <= 60 else ())]
    needs = [{t for t in words(x, c) if t in c} for x, c in wordings]

    def best(c):
        v = vector(c)
        told = [(x, u) for (x, u), need in zip(vectors, needs) if need <= c.keys() and not {*license_texts.FOREIGN.get(x, ())} & c.keys()]
        scored = [(round(sum(w * v.get(t, 0) for t, w in u.items()) / norm(u) / norm(v), 12), x) for x, u in told] if v else []
        top = max((s for s, _ in scored), default=0)
        return (min(x for s, x in scored if s == top), min(1.0, top)) if top else (None, 0.0)

    own, given = [], {}
    for path, text in files:
        lines = [c for c in map(terms, (text or "").split("\n")) if c]
        passages = [sum(lines[i : i + n], Counter()) for i in range(len(lines)) for n in (1, 2, 3, 4, 6, 8, 12, 16, 24)]
        name, score = max(map(best, passages), key=lambda x: x[1], default=(None, 0.0))
        whole, whole_score = best(terms(text))
        if tag := re.search(r"(?i)spdx-license-identifier: (\S+)", text or ""):  # of one identifier each, here
            name, score = re.sub("-or-later", "", tag[1]), 1.0
            whole, whole_score = best(terms((text or "").replace(tag[0], "")))
        own.append((path, name if score >= least else None, score))
        if path is not None:
            named = re.search(r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[a-z]+)?$", path) and max(score, whole_score) >= least_whole
            gives = whole if whole_score >= least_whole else name if named else None
            if gives:
                at = path.rpartition("/")[0]
                given[at] = min(given.get(at, (1, "")), (-max(score, whole_score), gives))
    for path, name, score in own:
        if name or path is None:
            yield path, name, score, "file" if name else None, None
            continue
        at = path.rpartition("/")[0]
        while at and at not in given:
            at = at.rpartition("/")[0]
        yield path, given[at][1] if at in given else None, score, "directory" if at in given else None, at if at in given else None


def same_scan(got, files):
    key = lambda r: str((r[0], r[1], r[3], r[4]))
    got, want = sorted(got, key=key), sorted(brute_scan(files), key=key)
    assert [(g[0], g[1], g[3], g[4]) for g in got] == [(w[0], w[1], w[3], w[4]) for w in want]
    # below the thresholds a passage may be passed over
    assert all(abs(g[2] - w[2]) < 2e-6 for g, w in zip(got, want) if w[2] >= 0.5) and all(g[2] < 0.5 for g, w in zip(got, want) if w[2] < 0.5)


def wrapped(text, width, mark):
    import textwrap

    return "\n".join(mark + line for line in textwrap.wrap(text, width))


def test_real_licenses(spark):
    """Full texts, wrapped headers, tags and clauses, with other words around them."""
    body = "\nimport something\nfor each in all of it do what is said\n"
    texts = license_texts.TEXTS
    rows = [
        ("a/mit.txt", "Copyright (c) 2020 Jane Doe\n\n" + wrapped(texts["MIT"][0], 80, ""), "MIT"),
        ("b/gpl.c", "/* prog - does things\n" + wrapped(texts["GPL-3.0"][0], 70, " * ") + "\n */" + body, "GPL-3.0"),
        ("c/agpl.py", wrapped(texts["AGPL-3.0"][0], 60, "# ") + body, "AGPL-3.0"),
        ("d/tag.c", "// SPDX-License-Identifier: GPL-2.0-or-later" + body, "GPL-2.0"),
        ("e/bsd.go", wrapped(texts["BSD-3-Clause"][0], 75, "// ") + body, "BSD-3-Clause"),
        ("f/bsd2.go", wrapped(texts["BSD-2-Clause"][0], 75, "// ") + body, "BSD-2-Clause"),
        ("g/apache.java", "/*\n" + wrapped(texts["Apache-2.0"][0], 65, " * ") + "\n */" + body, "Apache-2.0"),
        ("h/line.md", "Copyright (c) 2020 Jane Doe. This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("i/line.md", "This project is released under the MIT License and may be used freely by anyone.", "MIT"),
        ("j/mpl.js", wrapped(texts["MPL-2.0"][0], 72, " * ") + body, "MPL-2.0"),
        ("k/plain.py", body * 3, None),
        ("k/deep/er.py", body, None),
    ]
    docs = spark.createDataFrame([(i, *r[:2], 0.5) for i, r in enumerate(rows)] + [(None, None, None, None)], "doc_id long, path string, text string, score double")
    found = licenses.scan_licenses(docs, keep=["doc_id"]).collect()
    assert {r["doc_id"]: r["license"] for r in found} == {i: r[2] for i, r in enumerate(rows)} | {None: None}
    same_scan([r[1:] for r in found], [r[:2] for r in rows] + [(None, None)])


def test_relatives_and_unknown_licences(spark):
    """No licence is taken for a relative, and none that isn't known for one that is."""
    gnu = license_texts._gnu_header
    rows = [
        (wrapped(gnu("Lesser General Public License", "2.1"), 70, " * "), "LGPL-2.1"), ("SPDX-License-Identifier: EPL-2.0", "EPL-2.0"), ("// spdx-license-identifier: zlib", "Zlib"),
        ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"), ("SPDX-License-Identifier: LGPL-2.1-or-later", "LGPL-2.1"), ("SPDX-License-Identifier: MPL-1.1 */", "MPL-1.1"),
        ("Licensed under the Apache Software License, Version 1.1.", "Apache-1.1"), ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"), ("/* SPDX-License-Identifier: MIT OR Apache-2.0 */", "MIT OR Apache-2.0"),
        ("SPDX-License-Identifier: (GPL-2.0-only with Classpath-exception-2.0) AND Foo-1.0", "(GPL-2.0 WITH Classpath-exception-2.0) AND Foo-1.0"), ("SPDX-License-Identifier: LicenseRef-mine", "LicenseRef-mine"),
        ("SPDX-License-Identifier: (MIT", None), ("SPDX-License-Identifier:", None), ("SPDX-License-Identifier: MIT AND", "MIT"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 3.0 Unported License.", "CC-BY-NC-ND-3.0"), ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY 2.5.", None),
        (wrapped(gnu("General Public License", "1"), 70, "# "), None), ("This work is licensed under the GNU Lesser General Public License, version 2.", None), ("Licensed under the Foo License, Version 2.0.", None),
        ("Licensed under the Eclipse Public License v2.0.", "EPL-2.0"), ("Licensed under the Eclipse Public License v1.0.", "EPL-1.0"), (wrapped(license_texts.TEXTS["Zlib"][0], 60, ""), "Zlib"), (license_texts.TEXTS["BSL-1.0"][0], "BSL-1.0"),
        (wrapped(license_texts.TEXTS["0BSD"][0], 70, ""), "0BSD"), (wrapped(license_texts.TEXTS["BSD-4-Clause"][0], 70, ""), "BSD-4-Clause"), (wrapped(license_texts.TEXTS["MPL-1.1"][0], 70, ""), "MPL-1.1"),
    ]
    docs = spark.createDataFrame([(f"d{i}/x.c", t) for i, (t, _) in enumerate(rows)] + [(f"p{i}/y.c", "other words " * i) for i in range(60)], "path string, text string")
    found = {r["path"]: r["license"] for r in licenses.scan_licenses(docs).collect()}
    assert [found[f"d{i}/x.c"] for i in range(len(rows))] == [want for _, want in rows]


def test_scan_brute_force(spark, sf_dir):
    got = queries.op3_license_scan(spark, sf_dir).collect()
    docs = table(spark, sf_dir, "documents").collect()
    of_path = {f"{d['source'] or 'unknown'}/{d['lang'] or 'unknown'}/{d['doc_id']}": d["text"] for d in docs}
    frequencies, n = licenses.template_frequencies(table(spark, sf_dir, "documents"))
    texts = [{*licenses.TERM.findall((r["text"] or "").lower())} for r in docs]
    assert n == len(texts)
    assert all(frequencies.get(t, 0) == sum(t in x for x in texts) for t in ("license", "the", "public", "mit"))
    assert {r["path"] for r in got} == of_path.keys()
    cosine = licenses.Cosine(frequencies, n)
    for r in got:  # every passage of every whole text, without passing any over
        text = (of_path[r["path"]] or "").lower()
        best = max((cosine.best(c) for c in licenses.headers(text, {*licenses.TERM.findall(text)})), key=lambda x: x[1], default=(None, 0.0))
        assert (r["origin"] == "file") == (best[1] >= 0.6) and (r["origin"] != "file" or (r["license"] == best[0] and abs(r["score"] - best[1]) < 2e-6)), r


def test_null_ids(spark, tmp_path, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(5)
    docs.unionByName(spark.createDataFrame([(None, "Released under the MIT License.", None, None, 3)], docs.schema)).write.parquet(f"{tmp_path}/documents.parquet")
    assert [r["license"] for r in queries.op3_license_scan(spark, str(tmp_path)).collect() if r["doc_id"] is None] == ["MIT"]
