"""SQL that gives the rows of those corpus queries which SQL can express in reasonable time.

Byte windows (operator 10) take SQL minutes on small tables already; tests hold them against brute force instead.
"""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Marks around a turn: <|role|>, <|text|>, <|end|> and a line feed.
OP2 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, len(regexp_extract_all(text, '[<\[]\\*(?:\||/?s>|/?INST\]|/?<SYS>>|</SYS>>)')) + len(regexp_extract_all(role, '[<\[]\\*(?:\||/?s>|/?INST\]|/?<SYS>>|</SYS>>)')) AS escapes FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(text) + escapes + length('<|role|><|text|><|end|>') + 1) AS BIGINT) AS formatted_chars,
  CAST(0 AS BIGINT) AS n_attachments
FROM e GROUP BY conv_id
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS s FROM b, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS u(i) WHERE len(w) > 0),
q AS (SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS s FROM d, (SELECT DISTINCT m FROM p) AS ms, unnest(range(1, len(w) - m + 2)) AS u(i)),
f AS (SELECT doc_id, item_id, i, q.m FROM q JOIN p ON q.s = p.s AND q.m = p.m),
h AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM f, unnest(range(0, f.m)) AS u(k) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM f) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""

OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) AS u(i)),
m AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM s) WHERE least < doc_id),
g AS (SELECT DISTINCT doc_id, i + k AS i FROM m, unnest(range(0, 13)) AS u(k)),
k AS (SELECT d.doc_id, string_agg(d.w[p.i], ' ' ORDER BY p.i) AS kept FROM d, unnest(range(1, len(w) + 1)) AS p(i) LEFT JOIN g ON g.doc_id = d.doc_id AND g.i = p.i WHERE g.i IS NULL GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id) AS c ON c.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""

_TEXT = "coalesce(text, '')"
#: Every document under every order; nothing is summed ahead.
OP12 = rf"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, {_TEXT} AS text, regexp_extract_all({_TEXT}, '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(text) - length(translate(text, '{UPPER}', ''))) > 3 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l ON f.doc_id = l.doc_id),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM c a, c b, c c, c d, c e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, step, filter_order[step] AS own, filter_order[1:step - 1] AS before FROM o, unnest(range(1, 6)) AS u(step)),
r AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, own, contains(fails, own) AS bad, fails <> translate(fails, before, '') AS gone, fails = own AS alone, good, toxic FROM m, s),
a AS (SELECT part, filter_order, step, own, count(*) FILTER (WHERE NOT bad AND NOT gone) AS kept, count(*) FILTER (WHERE bad AND NOT gone) AS removed, count(*) FILTER (WHERE bad AND gone) AS redundant,
    count(*) FILTER (WHERE alone) AS unique_fails, count(*) FILTER (WHERE bad AND NOT gone AND good) AS good_lost, count(*) FILTER (WHERE bad AND NOT gone AND toxic) AS toxic_lost FROM r GROUP BY part, filter_order, step, own)
SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM a
"""



def _clustering(rounds: int = 10, clusters: int = 8, components: int = 64) -> str:
    """Every vector against every centroid in each round, as so many steps of a WITH clause."""
    distance = f"CAST(list_sum(list_transform(range(1, {components + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT)"
    steps = [
        f"""x AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda y: CAST(floor(1024 * CAST(y AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda y: y IS NOT NULL AND isfinite(y))) = {components})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS k, v AS c FROM x QUALIFY k < {clusters})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min(({distance}, k)) AS m FROM x, c{r} GROUP BY row)")
        if r < rounds:
            summed = "SELECT m[2] AS k, i, sum(v[i]) AS s, count(*) AS n FROM a{}, unnest(range(1, {})) AS u(i) GROUP BY ALL".format(r, components + 1)
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(n.c, o.c) AS c FROM c{r} o LEFT JOIN (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM ({summed}) GROUP BY k) n USING (k))")
    last = rounds
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, CAST(m[2] AS INTEGER) AS cluster, m[1] AS distance, CAST(sum(m[1]) OVER (PARTITION BY m[2]) AS BIGINT) AS cluster_inertia, CAST(sum(m[1]) OVER () AS BIGINT) AS inertia,
    sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{last} JOIN c{last} ON k = m[2]"""


#: Every query against every row.
OP11 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""

OP13 = _clustering()

SQL = {"op11_nearest_neighbours": OP11, "op13_centroid_clustering": OP13, "op12_filter_audit": OP12, "op2_chat_format": OP2, "op6_decontamination": OP6, "op9_substring_dedup": OP9}
