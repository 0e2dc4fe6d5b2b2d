"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

# A word: a run of characters other than space and the ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"


def _coverage(size: int) -> str:
    """Words inside a repeated window of `size` words, and their characters, by row."""
    return f"""
  g{size} AS (SELECT rid, i, array_to_string(list_slice(words, i, i + {size - 1}), ' ') AS gram
    FROM (SELECT rid, words, unnest(generate_series(1, len(words) - {size - 1})) AS i FROM docs WHERE len(words) >= {size})),
  m{size} AS (SELECT DISTINCT rid, place FROM (SELECT rid, unnest(generate_series(i, i + {size - 1})) AS place
    FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g{size}) WHERE n > 1)),
  c{size} AS (SELECT m.rid, count(*) AS n, sum(length(d.words[m.place])) AS chars FROM m{size} m JOIN docs d USING (rid) GROUP BY m.rid)"""


OP6 = f"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') AS words FROM documents),
  lines AS (SELECT rid, line, row_number() OVER (PARTITION BY rid, line ORDER BY nr) AS seen
    FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nr FROM docs)),
  dup AS (SELECT rid, count(*) AS n, sum(list_sum(list_transform(regexp_extract_all(line, '{WORD}'), lambda w: length(w)))) AS chars
    FROM lines WHERE seen > 1 AND len(regexp_extract_all(line, '{WORD}')) > 0 GROUP BY rid),
{_coverage(5)},
{_coverage(7)},
{_coverage(10)},
  counts AS (
  SELECT doc_id, len(words) AS n_words,
         coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(dup.n, 0) AS n_dup_lines, coalesce(c5.n, 0) AS n_repeat_words,
         coalesce(dup.chars, 0)::BIGINT AS dup_line_chars, coalesce(c5.chars, 0)::BIGINT AS dup_chars_5,
         coalesce(c7.chars, 0)::BIGINT AS dup_chars_7, coalesce(c10.chars, 0)::BIGINT AS dup_chars_10
  FROM docs LEFT JOIN dup USING (rid) LEFT JOIN c5 USING (rid) LEFT JOIN c7 USING (rid) LEFT JOIN c10 USING (rid)),
  judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counts)
SELECT *, NOT (base_failed OR 100 * dup_line_chars > 30 * word_chars OR 100 * n_symbols > 50 * n_words
  OR 100 * dup_chars_5 > 25 * word_chars OR 100 * dup_chars_7 > 22 * word_chars OR 100 * dup_chars_10 > 20 * word_chars) AS kept
FROM judged
"""

OP8 = r"""
WITH RECURSIVE lines AS (
  SELECT doc_id, text, place, plain, CASE WHEN regexp_matches(plain, '[0-9]') THEN regexp_replace(plain, '[^ ]*[0-9][^ ]*', '<*>', 'g') ELSE plain END AS masked
  FROM (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) AS place,
               trim(regexp_replace(unnest(string_split(text, chr(10))), '[\x20\x09-\x0D]+', ' ', 'g')) AS plain FROM documents)),
  leafed AS (SELECT *, len(string_split(masked, ' ')) AS tokens, array_to_string(list_slice(string_split(masked, ' '), 1, 3), ' ') AS lead FROM lines WHERE masked <> ''),
  strings AS (SELECT tokens, lead, masked, count(DISTINCT text) AS docs FROM leafed WHERE tokens >= 4 AND tokens - 1 >= 0.8 * tokens GROUP BY ALL),
  level AS (
  SELECT lead AS part, tokens, lead, masked, string_split(masked, ' ') AS words, docs, false AS joins FROM strings
  UNION ALL
  (WITH mixed AS (SELECT * FROM level WHERE NOT joins WINDOW w AS (PARTITION BY tokens, part)
      QUALIFY count(*) OVER w > 1 AND sum(docs) OVER w >= 2 AND count(*) FILTER (docs < 2) OVER w > 0),
    tok AS (SELECT tokens, part, docs, unnest(words) AS token, generate_subscripts(words, 1) AS place FROM mixed),
    places AS (SELECT tokens, part, place, arg_max(token, {'n': docs, 't': token}) AS common, count(*) AS kinds, count(*) FILTER (n = 1) AS single
      FROM (SELECT tokens, part, place, token, sum(docs) AS docs, count(*) AS n FROM tok GROUP BY ALL) GROUP BY ALL),
    parts AS (SELECT tokens, part, list(common ORDER BY place) AS template, arg_min(place, {'s': single, 'p': place}) FILTER (kinds > 1) AS telling FROM places GROUP BY ALL),
    judged AS (SELECT m.*, telling, len(list_filter(list_zip(words, template), lambda x: x[1] = x[2])) >= 0.8 * tokens AS now
      FROM mixed m JOIN parts p USING (tokens, part))
  SELECT CASE WHEN now THEN part ELSE part || chr(10) || telling || ' ' || words[telling] END, tokens, lead, masked, words, docs, now FROM judged)),
  members AS (SELECT part, tokens, lead, masked FROM level WHERE joins),
  grouped AS (SELECT l.doc_id, l.text, l.place, l.tokens, l.lead, m.part,
      CASE WHEN m.part IS NULL THEN CASE WHEN l.tokens < 4 THEN l.plain ELSE l.masked END END AS own
    FROM leafed l LEFT JOIN members m ON l.tokens = m.tokens AND l.lead = m.lead AND l.masked = m.masked),
  recurring AS (SELECT tokens, lead, part, own, arg_min(text, doc_id) AS first FROM grouped GROUP BY ALL HAVING count(DISTINCT text) >= 2),
  dropped AS (SELECT g.doc_id, list(g.place) AS places FROM grouped g JOIN recurring r
    ON g.tokens = r.tokens AND g.lead = r.lead AND g.part IS NOT DISTINCT FROM r.part AND g.own IS NOT DISTINCT FROM r.own WHERE g.text <> r.first GROUP BY g.doc_id)
SELECT doc_id,
  CASE WHEN places IS NULL THEN text ELSE coalesce(array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(places, i)), chr(10)), '') END AS text,
  len(string_split(text, chr(10))) AS n_lines, coalesce(len(places), 0) AS n_dropped
FROM documents LEFT JOIN dropped USING (doc_id)
"""

OP12 = """
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  scores AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM vectors a JOIN vectors b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
  positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""

ORACLE: dict[str, str] = {"op6_quality_rules": OP6, "op8_line_dedup": OP8, "op12_hard_negatives": OP12}
