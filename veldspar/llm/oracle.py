"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

from veldspar.llm.quality import STOP_WORDS


def _quality() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, list_transform(range(1, len(words) - 6), lambda i: list_aggregate(words[i:i + 7], 'string_agg', ' ')) AS grams FROM w WHERE len(words) >= 8),
p AS (SELECT doc_id, unnest(grams) AS gram, generate_subscripts(grams, 1) AS place FROM g),
r AS (SELECT doc_id, place FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM p) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT place + k) AS n_repeat_words FROM r, (SELECT unnest(range(8)) AS k) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(list_filter(words, lambda x: lower(x) IN ({stops}))) AS n_stops,
        len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis,
        len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•]\s'))) AS n_bullets
      FROM w LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2 AND 25 AND n_symbols / n_words <= 0.1 AND n_stops / n_words <= 0.98
  AND coalesce(n_dup_lines / nullif(n_lines, 0), 0) <= 0.5 AND coalesce(n_ellipsis / nullif(n_lines, 0), 0) <= 0.9
  AND coalesce(n_bullets / nullif(n_lines, 0), 0) <= 0.95 AS kept
FROM b"""


_WARC = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS held FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN held = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN held <> page_id THEN held END AS refers_to FROM f"""

_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 5"""

_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n_all FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n_all) AS n_lang FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
x AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n_all FROM g JOIN k ON g.lang = k.lang
        LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT lang, source, sum(n) AS n_group FROM x GROUP BY lang, source),
p AS (SELECT x.lang, x.source, x.term, x.n, 1 + 1000000000::HUGEINT * (x.n + 2) // (s.n_group + 2 * v.v) AS p,
        1 + 1000000000::HUGEINT * (x.n_all + 2) // (v.n_lang + 2 * v.v) AS q
      FROM x JOIN s ON x.lang = s.lang AND x.source = s.source JOIN v ON x.lang = v.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank FROM
  (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM o)
WHERE part = 'pair' OR rank <= 10"""

_CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, 33 + length(role) + length(text) + len(regexp_extract_all(role, p)) + len(regexp_extract_all(text, p)) AS size
      FROM c, (SELECT '[<\[]\\*(?:/?s>|/?INST\]|\|[A-Za-z0-9_]+\|>)' AS p))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(size)::BIGINT AS formatted_chars FROM e GROUP BY conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": _WARC, "op9_quality": _quality(), "op10_topk": _TOPK, "op11_divergence": _DIVERGENCE, "op13_chat": _CHAT}
