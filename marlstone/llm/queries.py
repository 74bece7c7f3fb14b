"""One query for each training-data operator, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from .chat import op5_chat_windows
from .embdedup import op10_embedding_dedup
from .extract import op12_html_extraction
from .fim import op11_fill_in_middle
from .hmm import op1_hmm_lm_score
from .langid import op7_language_id
from .mixing import op6_pfair_mixing
from .neighbours import op3_learned_partitions
from .packing import op4_best_fit_packing
from .pii import op2_pii_weak_supervision
from .repair import op13_conversation_repair
from .secrets import op9_secret_scan
from .simhash import op8_simhash_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_hmm_lm_score, op2_pii_weak_supervision, op3_learned_partitions, op4_best_fit_packing, op5_chat_windows, op6_pfair_mixing, op7_language_id,
        op8_simhash_dedup, op9_secret_scan, op10_embedding_dedup, op11_fill_in_middle, op12_html_extraction, op13_conversation_repair,
    )
}

ORACLE_SQL = {
    "op10_embedding_dedup": """
WITH RECURSIVE e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings
), p AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM e a JOIN e b ON a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.9
), r AS (
  SELECT vec_id, vec_id AS reach FROM embeddings
  UNION
  SELECT r.vec_id, p.w FROM r JOIN p ON p.u = r.reach
), c AS (SELECT vec_id, min(reach) AS component_id FROM r GROUP BY vec_id)
SELECT c.vec_id, (SELECT count(*) FROM p WHERE p.u = c.vec_id)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c
""",
    "op11_fill_in_middle": """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
         list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), i, 8))::BIGINT) AS h
  FROM documents
), c AS (
  SELECT *, len(tokens)::BIGINT AS n, least(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS a, greatest(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
              WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), s AS (
  SELECT *, array_to_string(tokens[1:a], '') AS p, array_to_string(tokens[a + 1:b], '') AS m, array_to_string(tokens[b + 1:], '') AS s FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM s
""",
    "op13_conversation_repair": """
WITH RECURSIVE crc AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
           lambda acc, c: list_reduce(list_prepend(xor(acc, c), [0, 1, 2, 3, 4, 5, 6, 7]::BIGINT[]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)),
           4294967295::BIGINT) % 20 AS fault
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM crc
), placed AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') AS conv,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(coalesce(conv_id::VARCHAR, ' ') || ':' || length(role) || ':' || role || text), copy) AS i,
         rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body
  FROM damaged
), faulty AS (
  SELECT *, left(role, 1) AS initial,
         CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f
  FROM placed
), pairs AS (
  SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM faulty
), sums AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate,
         count(*) FILTER (f = 't') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM pairs GROUP BY conv
), grown(q, x, r) AS ( -- state, after insertion, edits: states 0 nothing yet, 1 after s, 2 after u, 3 after a
  VALUES (0, 2, 'I'), (1, 2, 'I'), (2, 3, 'I'), (3, 2, 'I'), (0, 3, 'II'), (1, 3, 'II'), (2, 2, 'II'), (3, 3, 'II'), (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, '')
), best AS (
  SELECT conv, 0::BIGINT AS i, 0 AS q, 0::BIGINT AS cost, '' AS audit, [] :: VARCHAR[] AS said FROM sums
  UNION ALL
  SELECT conv, i, q, cost, audit, said FROM (
    SELECT b.conv, b.i + 1 AS i, e.q, b.cost + 2 * length(g.r) + e.cost AS cost, b.audit || g.r || e.edit AS audit,
           b.said || CASE g.r WHEN '' THEN []::VARCHAR[] WHEN 'I' THEN [CASE g.x WHEN 2 THEN 'user:' ELSE 'assistant:' END] ELSE [CASE g.x WHEN 3 THEN 'user:' ELSE 'assistant:' END, CASE g.x WHEN 3 THEN 'assistant:' ELSE 'user:' END] END || e.said AS said,
           row_number() OVER (PARTITION BY b.conv, e.q ORDER BY b.cost + 2 * length(g.r) + e.cost, b.audit || g.r || e.edit) AS best
    FROM best b JOIN grown g ON g.q = b.q JOIN faulty r ON r.conv = b.conv AND r.i = b.i + 1,
    LATERAL (
      SELECT g.x AS q, 3 AS cost, 'D' AS edit, []::VARCHAR[] AS said
      UNION ALL
      SELECT CASE r.initial WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, (r.f = 't')::INT, 'K', [r.role || ':' || r.text]
      WHERE r.f NOT IN ('b', 'd') AND (g.x = 0 AND r.initial = 's' OR g.x <> 2 AND r.initial = 'u' OR g.x = 2 AND r.initial = 'a')
      UNION ALL
      SELECT CASE g.x WHEN 2 THEN 3 ELSE 2 END, 2 + (r.f = 't')::INT, 'R', [CASE g.x WHEN 2 THEN 'assistant:' ELSE 'user:' END || r.text]
      WHERE r.f NOT IN ('b', 'd')
    ) e
  ) WHERE best = 1
), ends AS (
  SELECT b.conv, s.gaps, s.blank, s.duplicate, s.truncated, s.illegal, b.cost + 2 * length(g.r) AS cost, b.audit || g.r AS audit,
         b.said || CASE g.r WHEN '' THEN []::VARCHAR[] WHEN 'I' THEN ['assistant:'] ELSE ['user:', 'assistant:'] END AS said,
         row_number() OVER (PARTITION BY b.conv ORDER BY b.cost + 2 * length(g.r), b.audit || g.r) AS best
  FROM best b JOIN sums s ON s.conv = b.conv AND s.n = b.i JOIN grown g ON g.q = b.q AND (g.x = 3 OR g.x = 0)
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN ends e ON e.conv = coalesce(c.conv_id::VARCHAR, ' ') AND e.best = 1
""",
}
