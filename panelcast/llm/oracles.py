"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op6_quality_rules"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM t),
marked AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS n FROM win),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM marked WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT t.doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(text) - length(regexp_replace(text, '!', '', 'g')) AS n_exclaims,
         length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS n_capitals,
         length(text) - length(regexp_replace(text, '[\x21-\x40\x5B-\x60\x7B-\x7E]', '', 'g')) AS n_marks,
         len(lines) AS n_lines,
         len(list_filter(lines, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))
           - len(list_distinct(list_filter(lines, lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words
  FROM t LEFT JOIN covered c USING (doc_id)),
b AS (
  SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
    + 8 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT + 16 * (10 * n_dup_lines > 3 * n_lines)::INT
    + 32 * (10 * n_exclaims > n_words)::INT + 64 * (2 * n_capitals > word_chars)::INT + 128 * (2 * n_marks > word_chars)::INT AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, fail_bits & 3 <> 0 AS base_failed, fail_bits & 111 = 0 AS kept,
       fail_bits::BIGINT AS fail_bits
FROM b
"""

ORACLES["op8_mixing"] = r"""
WITH RECURSIVE masses AS (
  SELECT source, count(*) AS n_docs, sum(length(coalesce(text, '')) + 1)::BIGINT AS mass FROM documents GROUP BY source),
whole AS (SELECT sum(mass)::BIGINT AS total, count(*) AS n_sources FROM masses),
rates AS (SELECT source, (1.0::DOUBLE * (1.0::DOUBLE / n_sources)) * total / mass AS rate FROM masses, whole),
means AS (SELECT source, rate, greatest(1, ceil(rate / 32.0))::INT AS draws, rate / greatest(1, ceil(rate / 32.0))::INT AS mean FROM rates),
cdf AS (
  SELECT source, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM means
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < 119),
uniform AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '-') || ':' || sha256(coalesce(text, '')) AS k, d.source, unnest(range(1, draws + 1)) AS j FROM documents d JOIN means m ON d.source IS NOT DISTINCT FROM m.source),
drawn AS (
  SELECT u.doc_id, sum((SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM u.source
    AND cdf.c <= ('0x' || substr(sha256('17:' || u.k || ':' || u.j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE))::INT AS copies
  FROM uniform u GROUP BY u.doc_id),
spread AS (
  SELECT d.*, copies, rate, unnest(range(1, copies + 1))::INT AS copy
  FROM documents d JOIN drawn USING (doc_id) JOIN means m ON d.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, text, lang, source, n_chars, copy, copies, rate,
       ('0x' || substr(sha256('17:place:' || coalesce(doc_id::VARCHAR, '-') || ':' || sha256(coalesce(text, '')) || ':' || copy), 1, 15))::BIGINT AS shuffle_key
FROM spread
"""

ORACLES["op10_tool_calls"] = r"""
WITH RECURSIVE calls AS (
  SELECT c.conv_id, c.turn, 'call-' || c.conv_id || '-' || c.turn AS call_id, c.text AS prompt,
         CASE WHEN c.turn >= 2 THEN 'call-' || c.conv_id || '-' || (c.turn - 2) END AS after,
         p.turn IS NOT NULL AS has_parent
  FROM conversations c LEFT JOIN (SELECT conv_id, turn FROM conversations WHERE role = 'user') p
    ON p.conv_id = c.conv_id AND p.turn = c.turn - 2
  WHERE c.role = 'user'),
lev AS (
  SELECT conv_id, turn, 0 AS level FROM calls WHERE NOT has_parent
  UNION ALL
  SELECT c.conv_id, c.turn, level + 1 FROM calls c JOIN lev l ON l.conv_id = c.conv_id AND l.turn = c.turn - 2),
answers AS (
  SELECT conv_id, turn, 'call-' || conv_id || '-' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant')
SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.turn, a.turn) AS turn, coalesce(c.call_id, a.call_id) AS call_id,
       CASE WHEN c.call_id IS NOT NULL THEN 'reply' END AS tool, l.level, a.turn AS result_turn,
       (a.call_id IS NOT NULL)::BIGINT AS n_results,
       CASE WHEN c.call_id IS NULL THEN 'orphan_result' WHEN a.call_id IS NULL THEN 'no_result' ELSE 'linked' END AS status,
       concat_ws(',', CASE WHEN c.call_id IS NOT NULL AND prompt IS NULL THEN 'missing:prompt' WHEN prompt = '' THEN 'range:prompt' END,
         CASE WHEN after IS NOT NULL AND NOT has_parent THEN 'unknown_after' END) AS errors,
       '{"arguments":' || CASE WHEN c.call_id IS NULL THEN 'null' ELSE
           '{' || CASE WHEN after IS NOT NULL THEN '"after":"' || after || '",' ELSE '' END
           || CASE WHEN prompt IS NOT NULL THEN '"prompt":' || to_json(prompt) || ',' ELSE '' END || '"turn":' || c.turn || '}' END
         || ',"id":"' || coalesce(c.call_id, a.call_id) || '","name":' || CASE WHEN c.call_id IS NULL THEN 'null' ELSE '"reply"' END
         || ',"result":' || coalesce(to_json(a.text), 'null') || '}' AS json
FROM calls c LEFT JOIN lev l USING (conv_id, turn) FULL JOIN answers a ON a.call_id = c.call_id
UNION ALL
SELECT conv_id, turn, NULL, NULL, NULL, NULL, 0, 'other_turn', '',
       '{"content":' || coalesce(to_json(text), 'null') || ',"role":' || coalesce(to_json(role), 'null') || '}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""

ORACLES["op9_near_dedup"] = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2], w[i + 3])) END)) AS g
  FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id, doc_id AS r FROM t
  UNION
  SELECT reach.doc_id, sym.b FROM reach JOIN sym ON reach.r = sym.a)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r) AS component_id, t.doc_id = min(r) AS kept
FROM t JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY t.doc_id, n.n
"""

ORACLES["op12_fill_in_middle"] = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
d AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
         ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM u),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (
  SELECT *, array_to_string(units[1:a], '') AS pre, array_to_string(units[a + 1:b], '') AS mid, array_to_string(units[b + 1:], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def _code_rounds(rounds: int, parts: int = 16, entries: int = 64) -> str:
    """Plain k-means over vector parts: every part against every entry, in integers."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v,
         row_number() OVER (ORDER BY vec_id) AS rn, len(embedding) // {parts} AS w
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT vec_id, label, rn, p, v[p * w + 1:(p + 1) * w] AS x FROM v, range({parts}) t(p)),
b0 AS MATERIALIZED (SELECT p, rn - 1 AS e, x FROM s WHERE rn <= {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT s.rn, s.p, min({{'d': list_sum(list_transform(list_zip(s.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': b.e}}) AS m
  FROM s JOIN b{i} b ON s.p = b.p GROUP BY s.rn, s.p)""")
        if i < rounds:
            steps.append(f"""
b{i + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(n.x, b.x) AS x FROM b{i} b LEFT JOIN (
    SELECT p, e, list(floor(t / c)::BIGINT ORDER BY j) AS x FROM (
      SELECT a.p, a.m.e AS e, j, sum(s.x[j])::DOUBLE AS t, count(*)::DOUBLE AS c
      FROM a{i} a JOIN s ON s.rn = a.rn AND s.p = a.p, range(1, 1 + (SELECT max(w) FROM v)) u(j) GROUP BY 1, 2, 3) GROUP BY p, e) n
  ON n.p = b.p AND n.e = b.e)""")
    return f"""WITH {','.join(steps)},
c AS (SELECT rn, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY rn),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS digest FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256
FROM v JOIN c USING (rn), h"""


ORACLES["op11_vector_codes"] = _code_rounds(2)

_LEDGER = ORACLES["op6_quality_rules"].replace("SELECT t.doc_id,", "SELECT t.doc_id, t.source,").replace(
    "SELECT doc_id, coalesce(text, '') AS text,", "SELECT doc_id, source, coalesce(text, '') AS text,")
ORACLES["rule_ablation"] = _LEDGER[: _LEDGER.rindex("SELECT doc_id, n_words")] + """
SELECT source, rule, count(*) FILTER (WHERE fail_bits & bit <> 0) AS failed, count(*) FILTER (WHERE fail_bits & 111 = bit) AS only,
       count(*) FILTER (WHERE fail_bits & 111 <> 0) AS rejected, count(*) AS total
FROM b, (VALUES ('few_words', 1), ('repeated_windows', 2), ('symbol_density', 4), ('word_length', 8), ('exclamations', 32), ('capitals', 64)) r(rule, bit) GROUP BY source, rule
"""
