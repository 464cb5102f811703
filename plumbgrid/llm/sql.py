"""DuckDB SQL for the queries that SQL can express, in plain terms and without the operators' filters."""

from __future__ import annotations

from .licenses import LONGER, PHRASES, TEMPLATES, notice_words, template_words

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_WORDS = f"regexp_extract_all({_LOWER}, {_WORD})"


def _list(words) -> str:
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def licenses(threshold: float = 0.8) -> str:
    """Every word as the start of a block, without prefix, length or positional filter."""
    import math

    phrases = ", ".join(f"('{label}', {_list(p.split())})" for label, p in PHRASES)
    rows = []
    for k, (t, words) in enumerate(zip(TEMPLATES, template_words(TEMPLATES), strict=True)):
        size = len(notice_words(t.notice))
        rows.append(f"({k}, '{t.label}', {_list(words)}, {_list(t.must)}::VARCHAR[], {_list(t.never)}::VARCHAR[], {size + math.floor(size * LONGER)}, {math.ceil(threshold * len(words) - 1e-9)})")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
places AS (SELECT doc_id, label, i - 1 AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) t, (VALUES {phrases}) AS p(label, phrase) WHERE w[i:i + len(phrase) - 1] = phrase),
base AS (SELECT doc_id, count(*) AS n, min(word) AS a, max(word) AS b, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
t AS (SELECT * FROM (VALUES {", ".join(rows)}) AS t(k, label, words, must, never, size, need)),
pairs AS (SELECT doc_id, w, t.* FROM (SELECT doc_id, regexp_extract_all(lower(text), {_WORD}) AS w FROM d) x, t WHERE len(list_intersect(words, w)) >= need),
spelled AS (SELECT doc_id, k, label, words, must, never, size, need, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM pairs),
own AS (SELECT *, sum(CASE WHEN list_contains(never, word) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, k ORDER BY i) AS part FROM spelled WHERE list_contains(words, word) OR list_contains(never, word)),
held AS (SELECT doc_id, k, label, i, size, need, must, len(words) AS m, list_distinct(list(word) OVER (PARTITION BY doc_id, k, part ORDER BY i RANGE BETWEEN CURRENT ROW AND size - 1 FOLLOWING)) AS s FROM own WHERE NOT list_contains(never, word)),
blocks AS (SELECT *, len(s) * 1e0 / m AS c, lag(i) OVER (PARTITION BY doc_id, k ORDER BY i) AS before FROM held WHERE len(s) >= need AND list_has_all(s, must)),
more AS (SELECT doc_id, max(c) AS c, sum(CASE WHEN before IS NULL OR i - before >= size THEN 1 ELSE 0 END) AS n, list(DISTINCT label) AS labels FROM blocks GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, a AS first_word, b AS last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
  CASE WHEN base.n > 0 THEN 1e0 ELSE coalesce(c, 0e0) END AS score, CAST(coalesce(more.n, 0) AS BIGINT) AS n_blocks
FROM d LEFT JOIN base ON base.doc_id = d.doc_id LEFT JOIN more ON more.doc_id = d.doc_id"""


EMBEDDINGS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS id, vec_id AS reach FROM v UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reach),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT r.id AS vec_id, coalesce(max(n.n), 0) AS n_links, min(reach) AS component_id, r.id = min(reach) AS kept FROM r LEFT JOIN n ON n.a = r.id GROUP BY r.id"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0) t),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) k WHERE len(w) >= n) t),
m AS (SELECT doc_id, i, dw.n AS n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) t GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN its ON its.doc_id = d.doc_id"""

#: Targets: sources in the order of their limit by weight; those before the first that the rest's share doesn't fill are full.
MIXTURE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, CAST('0x' || substr(md5(concat_ws(':', CAST(doc_id AS VARCHAR), coalesce(text, ''))), 1, 8) AS BIGINT) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM d GROUP BY source),
u AS (SELECT *, (1.5e0 * sum(n) OVER () - 2 * (sum(n) OVER o - n)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS unit FROM s WINDOW o AS (ORDER BY n * 1e0 / w, source IS NULL, source ROWS UNBOUNDED PRECEDING)),
f AS (SELECT unit AS share FROM u WHERE unit * w <= 2 * n ORDER BY n * 1e0 / w, source IS NULL, source LIMIT 1),
g AS (SELECT source, n, CASE WHEN share * w > 2 * n THEN 2e0 * n ELSE share * w END AS target FROM u, f),
r AS (SELECT d.doc_id, d.size, g.n, g.target, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first,
  CASE WHEN g.n > 0 THEN CAST(floor(g.target / g.n) AS BIGINT) ELSE 0 END AS whole FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, n AS source_size, target, CAST(whole * size + least(greatest(CAST(floor(target) AS BIGINT) - whole * n - first, 0), size) AS BIGINT) AS taken FROM r"""
