"""SQL equivalents of the registered queries, where SQL can express them."""

from __future__ import annotations

ORACLES = {
    "op3_tree_merge_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare,
         row_number() OVER () AS id
  FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, first_value(id) OVER w AS keep_row,
         count(*) OVER (PARTITION BY bare) AS group_size
  FROM d WINDOW w AS (PARTITION BY bare ORDER BY points DESC, doc_id NULLS LAST, id)
)
SELECT doc_id, keep_id, group_size, id = keep_row AS kept, sha256(bare) AS text_sha256 FROM r
""",
    "op4_curriculum_mix": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS place
  FROM documents
), w AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS source_size,
         [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS weight
  FROM d GROUP BY source
), s AS (
  SELECT *, weight / sum(weight) OVER () AS part, CASE weight WHEN 5 THEN 1 ELSE 0 END
         - sum(CASE weight WHEN 5 THEN weight ELSE 0 END) OVER () / sum(weight) OVER () AS lean,
         sum(source_size) OVER () AS total
  FROM w
), rounds AS (
  SELECT 0 AS round, source, source_size, weight, CAST(NULL AS DOUBLE) AS target, false AS stopped FROM s
  UNION ALL
  SELECT round + 1, source, source_size, weight,
         CASE WHEN stopped THEN 3 * source_size ELSE least(3 * source_size, share) END,
         stopped OR share >= 3 * source_size
  FROM (
    SELECT *, weight * (sum(source_size) OVER () - sum(CASE WHEN stopped THEN 3 * source_size ELSE 0 END) OVER ())
           / nullif(sum(CASE WHEN stopped THEN 0 ELSE weight END) OVER (), 0) AS share FROM rounds
  ) WHERE round < 60
), t AS (
  SELECT rounds.source, CAST(rounds.source_size AS BIGINT) AS source_size, coalesce(target, 0) AS target,
         CAST(floor(coalesce(target, 0) + 1e-6) AS BIGINT) AS goal, s.part, s.total,
         s.part * (1 + 0.5 * s.lean) AS share0, s.part * (1 - 0.5 * s.lean) AS share1
  FROM rounds JOIN s ON rounds.source IS NOT DISTINCT FROM s.source WHERE round = 60
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN goal // t.source_size ELSE 0 END AS whole, goal, part, total, share0, share1,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY place, size ROWS UNBOUNDED PRECEDING) - d.size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN CAST(floor(1e-6 + total * least(1,
         2 * wanted / nullif(share0 + sqrt(greatest(share0 * share0 + 2 * (share1 - share0) * wanted, 0)), 0))) AS BIGINT) END AS position
FROM (
  SELECT *, CAST(whole * size + greatest(least(goal - whole * source_size - start, size), 0) AS BIGINT) AS taken,
         CAST(start AS DOUBLE) / nullif(goal, 0) * part AS wanted
  FROM r
)
""",
    "op2_parity_sketch_join": r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT r, array_to_string(w[i : i + 4], ' ') AS shingle
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
both_ AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b USING (shingle) WHERE a.r <> b.r GROUP BY ALL),
e AS (
  SELECT a, b FROM both_ JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), reach(r, x) AS (SELECT r, r FROM d UNION SELECT reach.r, e.b FROM reach JOIN e ON e.a = reach.x),
least_ AS (SELECT reach.r, min(doc_id) AS component_id FROM reach JOIN d ON d.r = reach.x GROUP BY reach.r)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d JOIN least_ USING (r) LEFT JOIN n USING (r)
""",
    "op6_event_sourced_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), f AS (
  SELECT *, 8 + length(role) + 1 + 8 + length(regexp_replace(regexp_replace(replace(text, chr(92), chr(92) || chr(92)),
    '<(s>|/s>|<SYS>>|</SYS>>|start_of_turn>|end_of_turn>|\|)', '<\\\1', 'g'), '\[(INST\]|/INST\])', '[\\\1', 'g')) AS chars
  FROM c
), t AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars)::BIGINT AS formatted_chars,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learned
  FROM f GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256, formatted_chars
FROM t
""",
    "op10_super_k_mer_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), v AS (
  SELECT r, i, array_to_string(w[i : i + 34], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
), again AS (SELECT s FROM v GROUP BY s HAVING count(*) > 1),
covered AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM v SEMI JOIN again USING (s)),
gone AS (SELECT r, count(*) AS n FROM covered GROUP BY r),
words AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS k FROM words ANTI JOIN covered USING (r, p) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(gone.n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
""",
}
