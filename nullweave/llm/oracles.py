"""The queries that SQL can express, as DuckDB SQL over the whole tables."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(lower: bool, pattern: str) -> str:
    text = f"TRANSLATE(COALESCE(text, ''), '{_UPPER}', '{_LOWER}')" if lower else "COALESCE(text, '')"
    return f"REGEXP_EXTRACT_ALL({text}, '{pattern}')"


_SPACED = r"[^\x20\x09-\x0D]+"
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

NEAR_DUPLICATES = f"""WITH RECURSIVE d AS (SELECT doc_id, {_words(True, _SPACED)} AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, ARRAY_TO_STRING(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, UNNEST(RANGE(1, GREATEST(LEN(w) - 4, 1) + 1)) AS i FROM d WHERE LEN(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * common >= 75 * (x.n + y.n - common)),
u AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, node) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, u.b FROM r JOIN u ON r.node = u.a),
c AS (SELECT doc_id, MIN(node) AS component_id FROM r GROUP BY 1),
k AS (SELECT doc_id, MD5(STRING_AGG(g, '|' ORDER BY g)) AS own FROM s GROUP BY 1),
m AS (SELECT doc_id, MIN(doc_id) OVER (PARTITION BY own) AS class_id FROM k)
SELECT c.doc_id, COALESCE(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept, COALESCE(class_id, c.doc_id) AS class_id
FROM c LEFT JOIN n ON c.doc_id = n.doc_id LEFT JOIN m ON c.doc_id = m.doc_id"""

TOP_K = """WITH v AS MATERIALIZED (SELECT vec_id, LIST_TRANSFORM(embedding, lambda x: CAST(FLOOR(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
 WHERE vec_id IS NOT NULL AND LEN(embedding) > 0 AND LIST_BOOL_AND(LIST_TRANSFORM(embedding, lambda x: x IS NOT NULL AND ISFINITE(x)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(LIST_SUM(LIST_TRANSFORM(RANGE(1, LEN(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND LEN(q.e) = LEN(c.e)),
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""

SUBSTRINGS = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_words(False, _SPACED)} AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, ARRAY_TO_STRING(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, UNNEST(RANGE(1, LEN(w) - 11)) AS i FROM d)),
m AS (SELECT g, MIN(doc_id) AS first FROM g GROUP BY 1),
x AS (SELECT DISTINCT doc_id, UNNEST(RANGE(i, i + 13)) AS p FROM g JOIN m USING (g) WHERE first < doc_id),
e AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, UNNEST(RANGE(1, LEN(w) + 1)) AS p FROM d)),
k AS (SELECT e.doc_id, STRING_AGG(word, ' ' ORDER BY e.p) AS kept FROM e ANTI JOIN x ON e.doc_id = x.doc_id AND e.p = x.p GROUP BY 1),
c AS (SELECT doc_id, COUNT(*) AS n FROM x GROUP BY 1)
SELECT d.doc_id, CAST(LEN(w) AS BIGINT) AS n_words, COALESCE(c.n, 0) AS n_removed, SHA256(COALESCE(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)"""

DECONTAMINATION = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_words(True, _WORDS)} AS w FROM documents),
b AS (SELECT item_id, {_words(True, _WORDS)} AS w FROM benchmark),
t AS MATERIALIZED (SELECT DISTINCT item_id, ARRAY_TO_STRING(w[i:i + 7], ' ') AS g, LEAST(LEN(w), 8) AS n FROM (SELECT item_id, w, UNNEST(RANGE(1, GREATEST(LEN(w) - 7, 1) + 1)) AS i FROM b WHERE LEN(w) > 0)),
f AS (SELECT doc_id, i, n, ARRAY_TO_STRING(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, UNNEST(RANGE(1, LEN(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM t))),
h AS MATERIALIZED (SELECT doc_id, i, f.n, item_id FROM f JOIN t ON f.g = t.g AND f.n = t.n),
c AS (SELECT doc_id, COUNT(DISTINCT p) AS n FROM (SELECT doc_id, UNNEST(RANGE(i, i + n)) AS p FROM h) GROUP BY 1),
o AS (SELECT doc_id, COUNT(*) AS n, STRING_AGG(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(LEN(w) AS BIGINT) AS n_words, COALESCE(c.n, 0) AS n_hit, COALESCE(o.n, 0) AS n_items, SHA256(COALESCE(items, '')) AS items_sha256, COALESCE(o.n, 0) >= 2 AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)"""
