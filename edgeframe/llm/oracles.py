"""DuckDB SQL for the rows of the queries that SQL can express."""

from __future__ import annotations

from .licenses import BASE, SHARE, TEMPLATES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(table: str, key: str, pattern: str) -> str:
    """(key, w): the words of each row, A-Z lower-cased."""
    return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{pattern}') AS w FROM {table}"


def near_duplicates(k: int, percent: int) -> str:
    """Single-linkage components over all pairs of sets that share a shingle."""
    return f"""WITH RECURSIVE tk AS ({_words("documents", "doc_id", "[^\\x20\\x09-\\x0D]+")}),
 sh AS (SELECT doc_id, CASE WHEN len(w) >= {k} THEN list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i : array_to_string(w[i:i + {k - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM tk),
 st AS (SELECT doc_id, len(s) AS n, list_sort(s) AS s FROM sh), cl AS (SELECT s, any_value(n) AS n, min(doc_id) AS id FROM st WHERE n > 0 GROUP BY s),
 ex AS (SELECT id, n, unnest(s) AS g FROM cl), pr AS (SELECT a.id AS x, b.id AS y, any_value(a.n) AS nx, any_value(b.n) AS ny, count(*) AS c FROM ex a JOIN ex b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id),
 ln AS (SELECT x, y FROM pr WHERE 100 * c >= {percent} * (nx + ny - c)), ed AS (SELECT x, y FROM ln UNION ALL SELECT y, x FROM ln),
 rc AS (SELECT id AS x, id AS y FROM cl UNION SELECT rc.x, ed.y FROM rc JOIN ed ON ed.x = rc.y), co AS (SELECT x, min(y) AS root FROM rc GROUP BY x),
 cc AS (SELECT st.doc_id, st.n, coalesce(co.root, st.doc_id) AS root FROM st LEFT JOIN cl ON cl.s = st.s AND st.n > 0 LEFT JOIN co ON co.x = cl.id)
 SELECT doc_id, n AS n_shingles, root AS component_id, doc_id = root AS kept FROM cc"""


def contamination(window: int) -> str:
    """Every window of every item looked up at every word of every document."""
    words = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
    lengths = f"SELECT DISTINCT least(len(w), {window}) AS n FROM ik WHERE len(w) > 0"
    return f"""WITH dk AS ({_words("documents", "doc_id", words)}), ik AS ({_words("benchmark", "CAST(item_id AS VARCHAR) AS item", words)}), ns AS ({lengths}),
 iw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT item, w, least(len(w), {window}) AS n, unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS i FROM ik WHERE len(w) > 0)),
 dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dk, ns WHERE len(w) >= n)),
 ht AS (SELECT dw.doc_id, dw.i, dw.n, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.t = iw.t),
 cv AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM ht)) GROUP BY doc_id),
 ow AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM ht) GROUP BY doc_id)
 SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM dk LEFT JOIN cv USING (doc_id) LEFT JOIN ow USING (doc_id)"""


def licenses() -> str:
    """Base phrases at every word, and every template at every place of its mandatory phrase."""
    listed = ", ".join(f"({i}, '{label}', string_split('{text}', ' '), string_split('{phrase}', ' '))" for i, (label, text, phrase) in enumerate(TEMPLATES))
    base = ", ".join(f"('{label}', string_split('{phrase}', ' '))" for phrase, label in BASE.items())
    return f"""WITH dk AS ({_words("documents", "doc_id", "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")}), wd AS (SELECT doc_id, w, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM dk),
 bp AS (SELECT * FROM (VALUES {base}) v(label, p)), tp AS (SELECT *, list_position(list_transform(range(1, len(t) + 1), lambda i : t[i:i + len(p) - 1] = p), true) AS o FROM (VALUES {listed}) v(id, label, t, p)),
 bh AS (SELECT doc_id, label, i - 1 AS i FROM wd JOIN bp ON x = p[1] AND w[i:i + len(p) - 1] = p),
 th AS (SELECT doc_id, label, list_sum(list_transform(range(1, len(t) + 1), lambda j : CASE WHEN i - o + j >= 1 AND w[greatest(i - o + j, 1)] = t[j] THEN 1 ELSE 0 END)) / len(t) AS share FROM wd JOIN tp ON x = p[1] AND w[i:i + len(p) - 1] = p),
 ba AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM bh GROUP BY doc_id),
 ve AS (SELECT doc_id, max(share) AS best FROM th WHERE share >= {SHARE} GROUP BY doc_id),
 la AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM bh UNION ALL SELECT doc_id, label FROM th WHERE share >= {SHARE}) GROUP BY doc_id)
 SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, greatest(CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END, coalesce(best, 0.0))::DOUBLE AS score
 FROM dk LEFT JOIN ba USING (doc_id) LEFT JOIN ve USING (doc_id) LEFT JOIN la USING (doc_id)"""
