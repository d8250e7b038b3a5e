"""SQL (DuckDB) of the queries that it can express, over the same tables."""

from __future__ import annotations

from . import quality

ORACLES: dict[str, str] = {}

_WORD = r"[^\x20\x09-\x0D]+"


def _closure(links: str, ids: str) -> str:
    """(id, component_id): the smallest id that links (a, b) reach from each of ids."""
    return f"""
    reach(id, other) AS (
        SELECT id, id FROM ({ids}) UNION SELECT r.id, l.b FROM reach r JOIN (SELECT a, b FROM ({links}) UNION ALL SELECT b, a FROM ({links})) l ON l.a = r.other
    ), component AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""


def _quality() -> str:
    tests = [(rule, score, c) for rule, (score, grid) in quality.RULES.items() for c in grid]
    share, counted = quality.ALPHA / len(quality.RULES), ", ".join(f"count(*) FILTER (({score}) > {c}) AS k{j}" for j, (_, score, c) in enumerate(tests))
    rows = " UNION ALL ".join(f"SELECT stratum, n_good, '{rule}' AS rule, {c} AS cutoff, k{j} AS k FROM counted" for j, (rule, _, c) in enumerate(tests))
    tail = f"list_sum([exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({share}::DOUBLE) + (n_good - i) * ln(1 - {share}::DOUBLE)) FOR i IN range(k + 1)])"
    failed = ", ".join(f"CASE WHEN ({score}) > (SELECT min(cutoff) FROM admissible a WHERE a.stratum IS NOT DISTINCT FROM m.lang AND a.rule = '{rule}') THEN '{rule}' END" for rule, (score, _) in quality.RULES.items())
    return rf"""
WITH texts AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS l FROM texts),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM texts)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM again, range(3) AS t(d) GROUP BY doc_id),
measured AS (
    SELECT t.doc_id, t.lang, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        length(regexp_replace(text, '[^!]', '', 'g')) AS n_shouts, len(l) AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
    FROM texts t JOIN lines USING (doc_id) LEFT JOIN repeated r USING (doc_id)
), based AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT} * n_words AS base_failed FROM measured),
truth AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
counted AS (SELECT lang AS stratum, count(*) AS n_good, {counted} FROM based SEMI JOIN truth USING (doc_id) WHERE NOT base_failed GROUP BY lang),
tests AS ({rows}),
admissible AS (SELECT * FROM tests WHERE n_good > 0 AND k < n_good * {share} AND {tail} <= {quality.DELTA} / ((SELECT count(*) FROM counted) * {len(tests)})),
judged AS (SELECT *, array_to_string(list_filter([{failed}], lambda x: x IS NOT NULL), ',') AS failed_rules FROM based m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM judged
"""


ORACLES["op4_quality"] = _quality()

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLES["op5_minhash"] = rf"""
WITH RECURSIVE texts AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
shingles AS (
    SELECT DISTINCT id, w[i] || ' ' || w[i + 1] AS s FROM (SELECT id, w, unnest(range(1, len(w))) AS i FROM texts WHERE len(w) > 1) UNION ALL SELECT id, w[1] FROM texts WHERE len(w) = 1
), sizes AS (SELECT id, count(*) AS n FROM shingles GROUP BY id),
links AS (
    SELECT a, b FROM (SELECT x.id AS a, y.id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.id < y.id GROUP BY ALL) JOIN sizes p ON p.id = a JOIN sizes q ON q.id = b
    WHERE 100 * common >= 80 * (p.n + q.n - common)
), {_closure("SELECT a, b FROM links", "SELECT id FROM texts")}
SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, id = component_id AS kept FROM component LEFT JOIN sizes USING (id)
"""

ORACLES["op7_vectors"] = f"""
WITH RECURSIVE vectors AS (
    SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0
), links AS (SELECT x.id AS a, y.id AS b FROM vectors x JOIN vectors y ON x.label = y.label AND len(x.v) = len(y.v) AND x.id < y.id WHERE list_cosine_similarity(x.v, y.v) >= 0.98
), {_closure("SELECT a, b FROM links", "SELECT vec_id AS id FROM embeddings")},
counts AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM component LEFT JOIN counts USING (id)
"""

#: Conversations without a tool call or result, as the driver's are: those would need JSON of any shape.
ORACLES["op8_chat"] = """
SELECT conv_id, turn, coalesce(lower(trim(role)), 'unknown') AS role, turn AS order_turn, 0 AS level, FALSE AS is_result, 0::BIGINT AS n_calls, 0::BIGINT AS n_answered, 0::BIGINT AS n_invalid, 'plain' AS status,
    to_json({'content': coalesce(text, ''), 'role': coalesce(lower(trim(role)), 'unknown')})::VARCHAR AS json
FROM conversations
"""

ORACLES["op10_substrings"] = """
WITH texts AS (SELECT doc_id, encode(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
windows AS (SELECT doc_id, i, md5(array_slice(h, i + 1, i + 100)) AS m FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM texts)),
repeated AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY m ORDER BY doc_id, i) > 1),
steps AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM repeated),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM steps) GROUP BY doc_id, run),
cuts AS (
    SELECT doc_id, coalesce(lag(b) OVER w, 0) AS start, a AS stop FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
    UNION ALL SELECT t.doc_id, coalesce(max(b), 0), any_value(n) FROM texts t LEFT JOIN spans s ON s.doc_id = t.doc_id GROUP BY t.doc_id
), kept AS (SELECT c.doc_id, string_agg(CASE WHEN stop > start THEN hex(array_slice(h, start + 1, stop)) ELSE '' END, '' ORDER BY start) AS k FROM cuts c JOIN texts t ON t.doc_id = c.doc_id GROUP BY c.doc_id),
removed AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT t.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM texts t JOIN kept USING (doc_id) LEFT JOIN removed USING (doc_id)
"""

