"""DuckDB SQL for the catalogue: a library of common table expressions, and a SELECT for each query."""

from __future__ import annotations

import re

from ..functions.stem import duckdb_sql
from ..operators.fusion import TEMPLATES

#: Questions of every form, with ids that no table has.
ASKED = [
    (-1, "What links Alpha Tower, Beta Bridge, and Gamma Gate?"),
    (-2, "How does rain and snow form?"),
    (-3, "Which tower combines old stone with new glass?"),
    (-4, "Tell me what links Alpha Tower and Beta Bridge"),
    (-5, "what connects the thing that is the and nation that was for the"),
    (-6, "Who built the bridge in the 1820s or in 1945, 18265 years on?"),
    (-7, ""),
    (-8, "how do the children and the elders of the 1790s speak"),
]
TOKENS = ["be", "the", "sky", "flies", "caresses", "1820s", "running", "modernized", "captained", "rational", "feed", "yying", "1825s", "1820sx", "1826", "18265", "agreed", "hopping", "falling", "relational", "conditional", "valency", "digitizer", "vietnamization", "hopefulness", "formality", "electrical", "triplicate", "adjustable", "adoption", "controlling", "rolling", "syzygy", "happy", "toyed", "playing", "yes", "yyy", "eyed", "boxes", "troubling", "sized", "probate", "cease", "controll"]


def _values(rows: list[tuple]) -> str:
    quote = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


HOP = r"(?i)^(?:what links|how do|how does|what connects)\s+(.+)"
COMBINES = r"(?i)^which .+ combines (.+?) with (.+)"
TAIL = r"[?.,]+$"
ENDS = r"^\s+|\s+$"

CTES: dict[str, str] = {
    "pages": f"SELECT doc_id AS page_id, regexp_replace(coalesce(source, ''), '{ENDS}', '', 'g') AS title, regexp_replace(coalesce(text, ''), '{ENDS}', '', 'g') AS content FROM documents",
    "split_": r"SELECT *, list_filter(string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS sents, list_filter(string_split_regex(content, '\s+'), lambda x: x <> '') AS words FROM pages",
    "parts": "SELECT page_id, 0 AS pos, 'summary' AS chunk_type, title || '. ' || CASE WHEN len(sents) > 0 THEN array_to_string(sents[1:2], ' ') ELSE substr(content, 1, 300) END AS text FROM split_ UNION ALL SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY s), 'body', title || '. ' || array_to_string(words[s + 1:s + 200], ' ') FROM (SELECT *, unnest(range(0, len(words), 150)) AS s FROM split_) WHERE len(words) - s >= 20",
    "chunks": "SELECT row_number() OVER (ORDER BY page_id, pos) - 1 AS chunk_id, page_id, chunk_type, text FROM parts",
    "raw": "SELECT chunk_id, term, count(*) AS n FROM (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM chunks) GROUP BY chunk_id, term",
    "terms": "SELECT DISTINCT term FROM raw",
    "page_terms": "SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(lower(content), '[a-z0-9]+')) AS term FROM pages)",
    "stems": duckdb_sql("terms"),
    "tf": "SELECT chunk_id, term, sum(n)::BIGINT AS tf FROM (SELECT chunk_id, stem AS term, n FROM raw JOIN stems USING (term) UNION ALL SELECT chunk_id, term, n FROM raw JOIN stems USING (term) WHERE stem <> term) GROUP BY chunk_id, term",
    "df": "SELECT term, count(*) AS df FROM tf GROUP BY term",
    "dl": "SELECT chunk_id, sum(tf)::BIGINT AS dl FROM tf GROUP BY chunk_id",
    "stats": "SELECT (SELECT count(*) FROM chunks) AS n, (SELECT coalesce(sum(tf), 0) FROM tf)::DOUBLE / greatest((SELECT count(*) FROM chunks), 1) AS avgdl",
    "vocab": "SELECT term, df FROM df, stats WHERE df <= floor(n * 0.5::DOUBLE)",
    "postings": "SELECT term, chunk_id, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS score FROM tf JOIN vocab USING (term) JOIN dl USING (chunk_id), stats",
    "ids": "SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, df FROM vocab",
    "asked": f"SELECT item_id AS query_id, text AS query FROM benchmark UNION ALL SELECT * FROM ({_values(ASKED)}) t(query_id, query)",
    "hops": rf"SELECT query_id, query, regexp_replace(query, '{ENDS}', '', 'g') AS s, regexp_extract(regexp_replace(query, '{ENDS}', '', 'g'), '{HOP}', 1) AS rest FROM asked",
    "long": rf"SELECT *, list_transform(list_filter(string_split_regex(rest, ',\s+(?:and\s+)?|\s+and\s+'), lambda p: length(regexp_replace(p, '{ENDS}', '', 'g')) > 5), lambda p: regexp_replace(regexp_replace(p, '{ENDS}', '', 'g'), '{TAIL}', '')) AS ps FROM hops",
    "subs": rf"SELECT query_id, query, CASE WHEN rest <> '' AND len(ps) >= 2 THEN ps WHEN regexp_matches(s, '{COMBINES}') THEN [regexp_replace(regexp_extract(s, '{COMBINES}', 1), '{ENDS}', '', 'g'), regexp_replace(regexp_replace(regexp_extract(s, '{COMBINES}', 2), '{ENDS}', '', 'g'), '{TAIL}', '')] ELSE [query] END AS parts FROM long",
    "streams": "SELECT query_id, i - 1 AS stream_id, 8.0::DOUBLE AS weight, false AS years_only, parts[i] AS text FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM subs) UNION ALL SELECT query_id, len(parts), 4.0::DOUBLE, false, query FROM subs WHERE len(parts) > 1 UNION ALL SELECT query_id, len(parts) + (len(parts) > 1)::INT, 4.0::DOUBLE, true, query FROM subs",
    "qraw": "SELECT DISTINCT query_id, stream_id, years_only, term FROM (SELECT query_id, stream_id, years_only, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM streams)",
    "qwords": "SELECT DISTINCT term FROM qraw",
    "qstems": duckdb_sql("qwords"),
    "qterms": r"SELECT DISTINCT query_id, stream_id, term FROM (SELECT query_id, stream_id, (substr(term, 1, 4)::INT + unnest(range(10)))::VARCHAR AS term FROM qraw WHERE regexp_matches(term, '^\d{4}s') UNION ALL SELECT query_id, stream_id, term FROM qraw WHERE regexp_matches(term, '^\d{4}$') UNION ALL SELECT query_id, stream_id, unnest([stem, term]) FROM qraw JOIN qstems USING (term) WHERE NOT years_only AND NOT regexp_matches(term, '^\d{4}(?:s|$)'))",
    "hits": "SELECT *, row_number() OVER (PARTITION BY query_id, stream_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, stream_id, chunk_id, round(sum(score), 6) AS score FROM postings JOIN qterms USING (term) GROUP BY ALL) WHERE score > 0 QUALIFY rank <= 200",
    "fused": "SELECT query_id, chunk_id, sum(weight / (60 + rank)) AS rrf, min((stream_id, rank)) AS first FROM hits JOIN streams USING (query_id, stream_id) GROUP BY query_id, chunk_id",
    "pooled": "SELECT query_id, page_id, round(max(rrf * CASE WHEN chunk_type = 'summary' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END), 9) AS score, min(first) AS first FROM fused JOIN chunks USING (chunk_id) GROUP BY query_id, page_id",
    "ranked": "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, page_id) AS rank, page_id, score FROM pooled QUALIFY rank <= 10",
    "relevant": "SELECT item_id AS query_id, doc_id AS page_id FROM documents d, benchmark b WHERE contains(d.text, b.text)",
    "gains": "SELECT query_id, sum(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 1 / log2(rank) END) AS dcg FROM ranked JOIN relevant USING (query_id, page_id) GROUP BY query_id",
    "ideals": "SELECT query_id, list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda i: CASE WHEN i <= 1 THEN 1.0::DOUBLE ELSE 1 / log2(i) END)) AS ideal FROM relevant GROUP BY query_id",
    "ndcg": "SELECT query_id, CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0.0 END AS ndcg FROM asked LEFT JOIN ideals USING (query_id) LEFT JOIN gains USING (query_id)",
    "spread": r"SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY place, year) AS pos, term FROM (SELECT query_id, place, 0 AS year, term FROM eraw WHERE NOT regexp_matches(term, '^\d{4}s') UNION ALL SELECT query_id, place, year, (substr(term, 1, 4)::INT + year)::VARCHAR FROM (SELECT *, unnest(range(10)) AS year FROM eraw WHERE regexp_matches(term, '^\d{4}s')))",
    "eraw": "SELECT query_id, unnest(range(1, len(t) + 1)) AS place, unnest(t) AS term FROM (SELECT query_id, regexp_extract_all(lower(query), '[a-z0-9]+') AS t FROM asked)",
    "ewords": "SELECT DISTINCT term FROM spread",
    "estems": duckdb_sql("ewords"),
    "elists": "SELECT query_id, flatten(list(CASE WHEN stem = term THEN [term] ELSE [stem, term] END ORDER BY pos)) AS tokens, list_filter(list(term ORDER BY pos), lambda t: regexp_matches(t, '^[0-9]') OR length(t) > 6) AS again FROM spread JOIN estems USING (term) GROUP BY query_id",
    "early": "SELECT a.query_id, coalesce(list_concat(tokens, CASE WHEN len(tokens) > 1 THEN list_transform(range(1, len(tokens)), lambda i: tokens[i] || '_' || tokens[i + 1]) ELSE [] END, again), []) AS tokens FROM asked a LEFT JOIN elists USING (query_id)",
    "log": "SELECT 0::BIGINT AS op_seq, vec_id AS pos, 'insert' AS op, vec_id, embedding FROM embeddings WHERE vec_id < 300 UNION ALL SELECT 1, vec_id, 'delete', vec_id, NULL FROM embeddings WHERE vec_id % 7 = 0 OR vec_id >= 300 UNION ALL SELECT 3, vec_id, 'insert', vec_id, list_reverse(embedding) FROM embeddings WHERE vec_id BETWEEN 200 AND 449 UNION ALL SELECT 4, vec_id + x, 'delete', vec_id, NULL FROM embeddings, (VALUES (0), (1000000)) t(x) WHERE vec_id % 5 = 0",
    "done": "SELECT *, CASE WHEN op = 'insert' THEN prev IS NULL OR prev = 'delete' ELSE coalesce(prev = 'insert', false) END AS ok FROM (SELECT *, lag(op) OVER (PARTITION BY vec_id ORDER BY op_seq, pos) AS prev FROM log)",
    "versions": "SELECT * FROM (SELECT op, vec_id, embedding, op_seq AS valid_from, lead(op_seq) OVER (PARTITION BY vec_id ORDER BY op_seq, pos) AS valid_to FROM done WHERE ok) WHERE op = 'insert'",
    "seen": "SELECT s AS op_seq, vec_id, embedding FROM versions, (VALUES (2::BIGINT), (5::BIGINT)) t(s) WHERE valid_from < s AND (valid_to IS NULL OR valid_to > s)",
    "scored": "SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0",
    "best": "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored QUALIFY rank <= 10",
    "asof_scored": "SELECT op_seq, q.vec_id AS query_id, a.vec_id, round(list_dot_product(q.embedding::DOUBLE[], a.embedding::DOUBLE[]), 6) AS score FROM embeddings q, seen a WHERE q.vec_id % 50 = 0",
    "asof_best": "SELECT op_seq, query_id, row_number() OVER (PARTITION BY op_seq, query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM asof_scored QUALIFY rank <= 10",
    "recalls": "SELECT query_id, count(a.vec_id)::DOUBLE / count(*) AS recall FROM best b LEFT JOIN (SELECT * FROM asof_best WHERE op_seq = 2) a USING (query_id, vec_id) GROUP BY query_id",
    "got": "SELECT op_seq, op, count(*) AS n, count(*) FILTER (ok) AS oks, count(*) FILTER (NOT ok) AS bads, count(DISTINCT vec_id) FILTER (ok) AS d_ok, count(DISTINCT vec_id) FILTER (NOT ok) AS d_bad, count(DISTINCT vec_id) FILTER (ok AND vec_id % 11 <> 0) AS t_ok, count(DISTINCT vec_id) FILTER (NOT ok AND vec_id % 11 <> 0) AS t_bad FROM done GROUP BY op_seq, op",
    "jac": "SELECT op_seq, op, n, CASE WHEN d_ok = 0 THEN 1.0::DOUBLE ELSE t_ok::DOUBLE / d_ok END AS ok, CASE WHEN d_bad = 0 THEN 1.0::DOUBLE ELSE t_bad::DOUBLE / d_bad END AS bad FROM got",
    "weighed": "SELECT op, sum(n::DOUBLE / total * (ok + bad) / 2) AS score FROM jac JOIN (SELECT op, sum(n) AS total FROM jac GROUP BY op) USING (op) GROUP BY op",
    "functional": "SELECT 0.5::DOUBLE * (SELECT avg(recall) FROM recalls) + 0.3::DOUBLE * (SELECT score FROM weighed WHERE op = 'insert') + 0.2::DOUBLE * (SELECT score FROM weighed WHERE op = 'delete') AS f",
    "tokens_": f"SELECT * FROM ({_values([(t,) for t in TOKENS])}) t(term)",
}

#: The log over every row, and what follows from it as from `log`.
CTES |= {
    "whole_log": "SELECT 0::BIGINT AS op_seq, vec_id AS pos, 'insert' AS op, vec_id, embedding FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT 1, vec_id, 'delete', vec_id, NULL FROM embeddings WHERE vec_id % 7 = 0 UNION ALL SELECT 3, vec_id, 'insert', vec_id, list_reverse(embedding) FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 4, vec_id + x, 'delete', vec_id, NULL FROM embeddings, (VALUES (0), (1099511627776)) t(x) WHERE vec_id % 5 = 0",
    "whole_done": CTES["done"].replace("FROM log", "FROM whole_log"),
    "whole_versions": CTES["versions"].replace("FROM done", "FROM whole_done"),
    "whole_seen": CTES["seen"].replace("FROM versions", "FROM whole_versions"),
    "told": "SELECT op_seq, op, vec_id, CASE WHEN vec_id % 13 = 0 THEN NOT ok ELSE ok END AS ok FROM whole_done WHERE vec_id % 11 <> 0",
    "agreed": "SELECT op_seq, op, count(*) FILTER (ok) AS any_ok, count(*) FILTER (ok AND a AND b) AS both_ok, count(*) FILTER (NOT ok) AS any_bad, count(*) FILTER (NOT ok AND a AND b) AS both_bad FROM (SELECT op_seq, op, vec_id, ok, bool_or(side = 'a') AS a, bool_or(side = 'b') AS b FROM (SELECT op_seq, op, vec_id, ok, 'a' AS side FROM whole_done UNION ALL SELECT op_seq, op, vec_id, ok, 'b' FROM told) GROUP BY ALL) GROUP BY op_seq, op",
    "whole_jac": "SELECT op_seq, op, n, CASE WHEN any_ok = 0 THEN 1.0::DOUBLE ELSE both_ok::DOUBLE / any_ok END AS ok, CASE WHEN any_bad = 0 THEN 1.0::DOUBLE ELSE both_bad::DOUBLE / any_bad END AS bad FROM agreed JOIN (SELECT op_seq, op, count(*) AS n FROM whole_done GROUP BY op_seq, op) USING (op_seq, op)",
    "whole_weighed": "SELECT op, sum(n::DOUBLE / total * (ok + bad) / 2) AS score FROM whole_jac JOIN (SELECT op, sum(n) AS total FROM whole_jac GROUP BY op) USING (op) GROUP BY op",
    "whole_asked": "SELECT 2::BIGINT AS op_seq, vec_id AS query_id, embedding AS qvec FROM embeddings WHERE vec_id % 50 = 0 UNION ALL SELECT 5, vec_id, embedding FROM embeddings WHERE vec_id % 20 = 0",
    "whole_best": "SELECT op_seq, query_id, row_number() OVER (PARTITION BY op_seq, query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM (SELECT op_seq, query_id, vec_id, round(list_dot_product(qvec::DOUBLE[], embedding::DOUBLE[]), 6) AS score FROM whole_asked JOIN whole_seen USING (op_seq)) QUALIFY rank <= 10",
    "whole_true": "SELECT op_seq, query_id, row_number() OVER (PARTITION BY op_seq, query_id ORDER BY score DESC, vec_id) AS rank, vec_id FROM (SELECT op_seq, query_id, e.vec_id, round(list_dot_product(qvec::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM whole_asked, embeddings e) QUALIFY rank <= 10",
    "whole_recalls": "SELECT op_seq, query_id, count(b.vec_id)::DOUBLE / count(*) AS recall FROM whole_true t LEFT JOIN whole_best b USING (op_seq, query_id, vec_id) GROUP BY op_seq, query_id",
    "whole_functional": "SELECT 0.5::DOUBLE * (SELECT avg(recall) FROM whole_recalls) + 0.3::DOUBLE * (SELECT score FROM whole_weighed WHERE op = 'insert') + 0.2::DOUBLE * (SELECT score FROM whole_weighed WHERE op = 'delete') AS f",
}

#: The hybrid retriever: the whole query's terms, and letter counts of queries, hypothetical texts and chunks.
LETTERS = "list_transform(range(26), lambda i: 2 * length(text) - length(replace(text, chr((65 + i)::INT), '')) - length(replace(text, chr((97 + i)::INT), '')))"
UNIT = "list_transform(c, lambda x: (x / greatest(sqrt(list_sum(list_transform(c, lambda y: y * y))), 1e-12::DOUBLE))::FLOAT)::DOUBLE[]"
CTES |= {
    "hraw": "SELECT DISTINCT query_id, 0 AS stream_id, false AS years_only, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM asked",
    "hwords": "SELECT DISTINCT term FROM hraw",
    "hstems": duckdb_sql("hwords"),
    "hterms": CTES["qterms"].replace("qraw", "hraw").replace("qstems", "hstems"),
    "hhits": CTES["hits"].replace("qterms", "hterms"),
    "htexts": f"SELECT query_id, -1 AS variant, query AS text FROM asked UNION ALL SELECT query_id, variant, replace(t, '{{query}}', query) FROM asked, ({_values([(i, t) for i, t in enumerate(TEMPLATES)])}) v(variant, t)",
    "hvectors": f"SELECT query_id, variant, {UNIT} AS q FROM (SELECT query_id, variant, {LETTERS} AS c FROM htexts)",
    "cvectors": f"SELECT chunk_id, {UNIT} AS e FROM (SELECT chunk_id, {LETTERS} AS c FROM chunks)",
    "hnear": "SELECT query_id, variant, chunk_id, row_number() OVER (PARTITION BY query_id, variant ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, variant, chunk_id, round(list_dot_product(q, e), 6) AS score FROM hvectors, cvectors) QUALIFY rank <= 200",
    "hlists": "SELECT query_id, 0 AS stream_id, 4.0::DOUBLE AS weight, chunk_id, rank FROM hhits UNION ALL SELECT query_id, variant + 2, 1.0::DOUBLE, chunk_id, rank FROM hnear",
    "hfused": "SELECT query_id, chunk_id, sum(weight / (60 + rank)) AS rrf, min((stream_id, rank)) AS first FROM hlists GROUP BY query_id, chunk_id",
    "hpooled": CTES["pooled"].replace("FROM fused", "FROM hfused"),
    "hranked": CTES["ranked"].replace("FROM pooled", "FROM hpooled"),
    "dvectors": f"SELECT doc_id, {UNIT} AS e FROM (SELECT doc_id, {LETTERS} AS c FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))",
}

FINAL: dict[str, str] = {
    "corpus_scan": "SELECT page_id, title, md5(content) AS content_md5 FROM pages",
    "sentence_split": "SELECT page_id, unnest(range(len(sents))) AS pos, unnest(sents) AS sentence FROM split_",
    "chunk_summary": "SELECT page_id, pos::BIGINT AS pos, md5(text) AS text_md5 FROM parts WHERE chunk_type = 'summary'",
    "chunk_body": "SELECT page_id, pos::BIGINT AS pos, md5(text) AS text_md5 FROM parts WHERE chunk_type = 'body'",
    "chunk_all": "SELECT chunk_id, page_id, chunk_type, md5(text) AS text_md5 FROM chunks",
    "chunk_meta": "SELECT chunk_id, page_id, chunk_type FROM chunks",
    "tokenize_index": "SELECT term, sum(tf)::BIGINT AS n FROM tf GROUP BY term",
    "stem_vocab": f"SELECT term, stem FROM ({duckdb_sql('page_terms')})",
    "stem_cases": f"SELECT term, stem FROM ({duckdb_sql('tokens_')})",
    "decade_expand": r"SELECT term AS token, out, regexp_matches(term, '^\d{4}(?:s|$)') AS year_stream FROM (SELECT term, (substr(term, 1, 4)::INT + unnest(range(10)))::VARCHAR AS out FROM tokens_ WHERE regexp_matches(term, '^\d{4}s') UNION ALL SELECT term, term FROM tokens_ WHERE NOT regexp_matches(term, '^\d{4}s'))",
    "query_decompose": "SELECT query_id, unnest(range(len(parts))) AS pos, unnest(parts) AS part FROM subs",
    "query_streams": "SELECT query_id, stream_id::BIGINT AS stream_id, weight, years_only, text FROM streams",
    "tokenize_query": "SELECT query_id, stream_id::BIGINT AS stream_id, term FROM qterms",
    "bm25_df": "SELECT term, df FROM df",
    "bm25_tf": "SELECT chunk_id, term, tf FROM tf",
    "bm25_doclen": "SELECT chunk_id, dl FROM dl",
    "bm25_stats": "SELECT n, round(avgdl, 6) AS avgdl FROM stats",
    "bm25_vocab": "SELECT term, term_id, df FROM ids",
    "bm25_postings": "SELECT term, chunk_id, round(score, 6) AS score FROM postings",
    "csr_offsets": "SELECT term_id, n, (sum(n) OVER (ORDER BY term_id) - n)::BIGINT AS first FROM (SELECT term_id, count(*) AS n FROM postings JOIN ids USING (term) GROUP BY term_id)",
    "bm25_topk": "SELECT query_id, stream_id::BIGINT AS stream_id, chunk_id, score, rank FROM hits",
    "rrf_fuse": "SELECT query_id, chunk_id, round(rrf, 9) AS rrf FROM fused",
    "search_pages": "SELECT query_id, rank, page_id, score FROM ranked",
    "page_rank": "SELECT query_id, rank, page_id, score FROM ranked",
    "search_lists": "SELECT query_id, coalesce(l, '') AS page_ids FROM asked LEFT JOIN (SELECT query_id, string_agg(page_id::VARCHAR, ',' ORDER BY rank) AS l FROM ranked GROUP BY query_id) USING (query_id)",
    "ndcg_at_10": "SELECT query_id, round(ndcg, 9) AS ndcg FROM ndcg",
    "mean_ndcg": "SELECT round(coalesce(avg(ndcg), 0), 9) AS mean_ndcg FROM ndcg WHERE query_id IN (SELECT item_id FROM benchmark)",
    "hyde_texts": "SELECT query_id, variant, replace(t, '{query}', query) AS text FROM asked, (VALUES (0::BIGINT, 'This Wikipedia article answers the query ''{query}''. It discusses the relevant facts, background, and key details.'), (1::BIGINT, 'A Wikipedia page about {query} would describe the specific person, place, event, or concept involved.'), (2::BIGINT, 'The answer to ''{query}'' can be found in a Wikipedia article covering the topic in detail.')) v(variant, t)",
    "bigrams": "SELECT query_id, (i - 1)::BIGINT AS pos, t[i] || '_' || t[i + 1] AS pair FROM (SELECT item_id AS query_id, t, unnest(range(1, len(t))) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark))",
    "legacy_tokens": "SELECT query_id AS text_id, coalesce(array_to_string(tokens, ' '), '') AS tokens FROM early",
    "legacy_bm25": "SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(sum(score), 6) AS score FROM postings JOIN (SELECT DISTINCT query_id, unnest(tokens) AS term FROM early) USING (term) WHERE term IN (SELECT term FROM df, stats WHERE df <= floor(n * 0.05::DOUBLE)) GROUP BY ALL) WHERE score > 0 QUALIFY rank <= 200",
    "vec_insert_result": "SELECT op_seq, pos, vec_id, ok FROM done WHERE op = 'insert'",
    "vec_delete_result": "SELECT op_seq, pos, vec_id, ok FROM done WHERE op = 'delete'",
    "vec_active_asof": "SELECT op_seq, vec_id, round(embedding[1]::DOUBLE, 6) AS first FROM seen",
    "vec_topk": "SELECT query_id, rank, vec_id, score FROM best",
    "vec_topk_columns": "SELECT query_id, rank, vec_id, score FROM best",
    "vec_search_asof": "SELECT query_id, rank, vec_id, score FROM asof_best WHERE op_seq = 5",
    "recall_at_10": "SELECT query_id, recall FROM recalls",
    "jaccard_mutations": "SELECT op_seq, round(ok, 9) AS ok, round(bad, 9) AS bad FROM jac",
    "scenario_score": "SELECT round(f, 9) AS functional, 0.9::DOUBLE AS multiplier, round(f * 0.9::DOUBLE, 9) AS final FROM functional",
    "replay_outcomes": "SELECT op_seq, op, n, round(ok, 9) AS ok, round(bad, 9) AS bad FROM whole_jac",
    "replay_active": "SELECT op_seq, vec_id, round(embedding[1]::DOUBLE, 6) AS first FROM whole_seen",
    "replay_search": "SELECT op_seq, query_id, rank, vec_id, score FROM whole_best",
    "replay_score": "SELECT round(f, 9) AS functional, CASE WHEN 0.4 <= 0.5 THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS multiplier, round(f, 9) AS final FROM whole_functional",
    "ivf_recall": "SELECT true AS enough, count(*) FILTER (vec_id % 50 = 0) AS queries FROM embeddings",
    "runtime_multipliers": "SELECT ratio::DOUBLE AS ratio, (CASE WHEN ratio <= 0.5 THEN 1.0 WHEN ratio <= 1 THEN 0.9 WHEN ratio <= 2 THEN 0.75 ELSE 0.5 END)::DOUBLE AS multiplier FROM (VALUES (0.5), (0.51), (1.0), (1.01), (2.0), (2.01)) t(ratio)",
    "l2_normalized": "SELECT vec_id, 1.0::DOUBLE AS norm, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS first FROM embeddings",
    "ivf_all_lists": "SELECT query_id, rank, vec_id, score FROM best",
    "ivf_exact": "SELECT query_id, rank, vec_id, score FROM best",
    "model_letters": "SELECT doc_id AS text_id, 26::BIGINT AS dim, round(e[5], 6) AS e, round(e[20], 6) AS t FROM dvectors",
    "hybrid_pages": "SELECT query_id, rank, page_id, score FROM hranked",
    "store_outcomes": "SELECT op_seq, pos, op, vec_id, ok FROM whole_done",
    "store_active": "SELECT compacted, vec_id, round(embedding[1]::DOUBLE, 6) AS first FROM whole_seen, (VALUES (false), (true)) t(compacted) WHERE op_seq = 5",
    "stream_outcomes": "SELECT op_seq, pos, op, vec_id, ok FROM whole_done",
    "embed_hashing": "SELECT item_id AS text_id, 384::BIGINT AS dim, 1.0::DOUBLE AS norm FROM benchmark",
}


def _with(sql: str) -> str:
    """The expressions that a SELECT needs, in order of need."""
    needed: list[str] = []

    def add(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                add(CTES[name])
                if name not in needed:
                    needed.append(name)

    add(sql)
    return f"WITH {', '.join(f'{n} AS ({CTES[n]})' for n in needed)} {sql}" if needed else sql


ORACLE_SQL = {name: _with(sql) for name, sql in FINAL.items()}
