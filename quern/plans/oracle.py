"""SQL for DuckDB that gives the rows of each query in ``catalog``, written on its own terms."""

from __future__ import annotations

from ..operators.answer import REFUSAL
from ..operators.evaluate import RRF_CONSTANTS
from ..operators.retrieval import LEAD as PROMPT
from .catalog import SWEEP, THRESHOLD

DOCS = "docs AS (SELECT doc_id AS id, text FROM documents)"
QUESTIONS = "asked AS (SELECT item_id AS query_id, text FROM benchmark)"
#: All documents and questions, and the vectors of those that have one.
PAIRED = """docs AS (SELECT doc_id AS id, text FROM documents), asked AS (SELECT item_id AS query_id, text FROM benchmark),
vecs AS (SELECT doc_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM documents JOIN embeddings ON vec_id = doc_id),
qvecs AS (SELECT item_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM benchmark JOIN embeddings ON vec_id = item_id)"""
#: Over docs and asked.
BM25 = """toks AS (SELECT id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ts FROM docs),
stat AS (SELECT count(*) AS n, CASE WHEN count(*) = 0 THEN 0e0 ELSE CAST(sum(len(ts)) AS DOUBLE) / count(*) END AS avgdl FROM toks),
tf AS (SELECT id, dl, token, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS token FROM toks) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
idf AS (SELECT token, df, ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) AS idf FROM df, stat),
qtoks AS (SELECT query_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ts FROM asked),
qt AS (SELECT query_id, token, count(*) AS qtf, min(pos) AS pos FROM (SELECT query_id, unnest(ts) AS token, unnest(range(0, len(ts))) AS pos FROM qtoks) GROUP BY ALL),
scores AS (SELECT query_id, id, min(pos) AS pos, round(sum(qtf * idf * tf * 1.9e0 / (tf + 9e-1 * (6e-1 + 4e-1 * dl / avgdl))), 9) AS score
  FROM qt JOIN idf USING (token) JOIN tf USING (token), stat GROUP BY query_id, id),
lex AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos, id) AS rank FROM scores)"""
#: Over vecs and qvecs.
DENSE = """far AS (SELECT query_id, id, round(list_cosine_distance(q, v), 9) AS distance FROM qvecs, vecs),
dense AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM far)"""
EMBEDDED = """vecs AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
qvecs AS (SELECT vec_id AS query_id, label AS scope, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0)"""
JUDGED = """qrels AS (SELECT a.query_id, d.id, 1 + d.id % 2 AS grade FROM asked a JOIN docs d ON contains(d.text, a.text) WHERE a.text <> '')"""


def fused(name: str, lists: list[str], k: str = "10", by: str = "") -> str:
    """A CTE that fuses CTEs (query_id, id, rank)."""
    rows = " UNION ALL ".join(f"SELECT {by}query_id, id, rank, {n} AS list_no FROM {x}" for n, x in enumerate(lists))
    return f"""{name}_rows AS (SELECT {by}query_id, id, round(sum(1e0 / ({k} + rank)), 12) AS score, min(list_no * 1000000 + rank) AS first FROM ({rows}) GROUP BY ALL),
{name} AS (SELECT {by}query_id, id, score, row_number() OVER (PARTITION BY {by}query_id ORDER BY score DESC, first, id) AS rank FROM {name}_rows)"""


def hybrid(top_k: int, depth: int = 50, threshold: float | None = None) -> str:
    cut = f" AND distance <= {threshold}e0" if threshold is not None else ""
    return f"""{PAIRED}, {BM25}, {DENSE}, near AS (SELECT * FROM dense WHERE rank <= {depth}{cut}), words AS (SELECT * FROM lex WHERE rank <= {depth}),
{fused("fused", ["near", "words"])},
hybrid AS (SELECT f.query_id, f.id, n.distance, f.score, f.rank FROM fused f LEFT JOIN near n ON n.query_id = f.query_id AND n.id = f.id WHERE f.rank <= {top_k})"""


def metrics(run: str, by: str = "", params: str = "") -> str:
    """A CTE ``m`` with metrics of each judged query (and parameter)."""
    on = f"i.query_id = h.query_id{f' AND i.{by} = h.{by}' if by else ''}"
    head = f"{by}, " if by else ""
    return f"""{JUDGED}, ideal_rows AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS r FROM qrels),
ideal AS (SELECT {head}query_id, sum(CASE WHEN r <= 10 THEN (power(2e0, grade) - 1) / log2(r + 1e0) ELSE 0 END) AS idcg, count(*) AS relevant FROM ideal_rows{f', {params}' if params else ''} GROUP BY {head}query_id),
h AS (SELECT {head}query_id, sum(CASE WHEN rank <= 10 THEN (power(2e0, grade) - 1) / log2(rank + 1e0) ELSE 0 END) AS dcg, sum(CASE WHEN rank <= 10 THEN 1 ELSE 0 END) AS h10, sum(CASE WHEN rank <= 100 THEN 1 ELSE 0 END) AS h100, min(rank) AS first FROM {run} JOIN qrels USING (query_id, id) GROUP BY {head}query_id),
m AS (SELECT {f'i.{by}, ' if by else ''}i.query_id, CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END AS ndcg10, CAST(coalesce(h10, 0) AS DOUBLE) / relevant AS recall10, CAST(coalesce(h100, 0) AS DOUBLE) / relevant AS recall100, CASE WHEN first <= 10 THEN 1e0 / first ELSE 0 END AS mrr10 FROM ideal i LEFT JOIN h ON {on})"""


#: Over docs, asked, toks and qtoks: neighbours, the first 50 of which are ordered by their words.
NEAR_AGAIN = """again AS (SELECT n.query_id, n.id, n.distance, row_number() OVER (PARTITION BY n.query_id ORDER BY n.rank > 50, CASE WHEN n.rank <= 50 THEN len(list_intersect(list_distinct(q.ts), list_distinct(t.ts))) END DESC, n.rank) AS rank,
  CAST(len(list_intersect(list_distinct(q.ts), list_distinct(t.ts))) AS DOUBLE) AS rerank_score FROM {0} n JOIN qtoks q USING (query_id) JOIN toks t USING (id))"""
SCOPED = f"""{PAIRED}, scopes AS (SELECT item_id AS query_id, CASE WHEN item_id % 6 <> 5 THEN 'src' || (item_id % 20) END AS scope FROM benchmark)"""


def scoped_hybrid(top_k: int, base: str = SCOPED) -> str:
    return f"""{base}, {BM25}, {DENSE}, owners AS (SELECT doc_id AS id, source FROM documents),
own_near AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM far JOIN scopes USING (query_id) JOIN owners USING (id) WHERE scope IS NULL OR scope = source),
own_words AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos, id) AS rank FROM scores JOIN scopes USING (query_id) JOIN owners USING (id) WHERE scope IS NULL OR scope = source),
near AS (SELECT * FROM own_near WHERE rank <= 50 AND distance <= {THRESHOLD}e0), words AS (SELECT * FROM own_words WHERE rank <= 50),
{fused("fused", ["near", "words"])},
hybrid AS (SELECT f.query_id, f.id, n.distance, f.score, f.rank FROM fused f LEFT JOIN near n ON n.query_id = f.query_id AND n.id = f.id WHERE f.rank <= {top_k})"""


MEANS = "count(*) AS n_queries, round(avg(ndcg10), 6) AS ndcg10, round(avg(recall10), 6) AS recall10, round(avg(recall100), 6) AS recall100, round(avg(mrr10), 6) AS mrr10"
TURNS = "pages AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, turn + 1 AS page_number, text FROM conversations)"
SPACED = "pages AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, turn + 1 AS page_number, CASE WHEN turn % 3 = 1 THEN ' ' || chr(10) || ' ' ELSE ' ' || text || chr(10) END AS text FROM conversations)"
DOC_PAGES = "pages AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, 1 AS page_number, text FROM documents)"


def cut(pages: str, m: int, o: int, name: str = "cut") -> str:
    """A CTE of chunks over a CTE of pages."""
    s = m - o
    return f"""{name}_words AS (SELECT document_id, page_number, regexp_extract_all(coalesce(text, ''), '\\S+') AS ws FROM {pages}),
{name}_at AS (SELECT *, unnest(range(0, CASE WHEN len(ws) = 0 THEN 0 WHEN len(ws) <= {m} THEN 1 ELSE 1 + CAST(ceil((len(ws) - {m}) / {s}e0) AS BIGINT) END)) AS chunk_index FROM {name}_words),
{name} AS (SELECT document_id, page_number, chunk_index, array_to_string(ws[chunk_index * {s} + 1 : chunk_index * {s} + {m}], ' ') AS text, least(len(ws) - chunk_index * {s}, {m}) AS token_count FROM {name}_at)"""


NORMAL = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[\x00-\x09\x0b-\x1f\x7f]', '', 'g'), '[ ]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"""
ROUGH = "' ' || chr(9) || replace(replace(replace(text, ' of ', '  o' || chr(9) || 'f  '), chr(10), ' ' || chr(13) || chr(10) || chr(13) || chr(10) || ' ' || chr(13) || ' '), '. ', '.' || chr(13) || ' ') || chr(10) || ' '"
NORMAL_PAGES = f"clean AS (SELECT document_id, page_number, {NORMAL.format('text')} AS text FROM pages WHERE regexp_replace(coalesce(text, ''), '\\s+', '', 'g') <> '')"
ROUNDED = "round(distance, 6) AS distance, round(score, 9) AS score, rank"
PAIRS = f"""{DOCS}, {QUESTIONS}, {BM25}, pairs AS (SELECT l.query_id, l.id, l.rank, CAST(len(list_intersect(list_distinct(q.ts), list_distinct(t.ts))) AS DOUBLE) AS s FROM lex l JOIN qtoks q USING (query_id) JOIN toks t USING (id) WHERE l.rank <= 50)"""
ANSWERS = "answers AS (SELECT item_id AS query_id, text || ' [S2] and [S1][S2] [S9] [S1, S2] [S01] [S' || (item_id % 7) || ']' AS answer, {n} AS n_sources FROM benchmark)"
CITED = """said AS (SELECT query_id, n_sources, unnest(regexp_extract_all(answer, '\\[(S[0-9]+)\\]', 1)) AS label, unnest(range(0, len(regexp_extract_all(answer, '\\[(S[0-9]+)\\]', 1)))) AS pos FROM answers),
cited AS (SELECT query_id, label, min(pos) AS pos FROM said WHERE list_contains(list_transform(range(1, n_sources + 1), lambda i: 'S' || i), label) GROUP BY query_id, label)"""

ORACLE_SQL: dict[str, str] = {
    "tokenize": f"WITH {DOCS}, t AS (SELECT id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ts FROM docs) SELECT id, unnest(range(0, len(ts))) AS pos, unnest(ts) AS token FROM t",
    "normalize_text": f"SELECT doc_id AS id, {NORMAL.format(ROUGH)} AS text FROM documents",
    "normalize_question": r"SELECT item_id AS query_id, trim(regexp_replace('  ' || replace(text, ' ', ' ' || chr(9) || ' ') || chr(10), '\s+', ' ', 'g')) AS text FROM benchmark",
    "chunk_documents": f"WITH {DOC_PAGES}, {cut('pages', 450, 75)} SELECT * FROM cut",
    "chunk_documents_small": f"WITH {DOC_PAGES}, {cut('pages', 4, 1)} SELECT * FROM cut",
    "document_chunks": f"WITH {TURNS}, {NORMAL_PAGES}, {cut('clean', 40, 8)} SELECT * FROM cut",
    "term_frequency": f"WITH {DOCS}, {QUESTIONS}, {BM25} SELECT id, token, tf FROM tf",
    "document_frequency": f"WITH {DOCS}, {QUESTIONS}, {BM25} SELECT token, df, round(idf, 9) AS idf FROM idf",
    "index_stats": f"WITH {DOCS}, {QUESTIONS}, {BM25} SELECT n AS n_docs, round(avgdl, 9) AS avgdl FROM stat",
    "bm25_search": f"WITH {DOCS}, {QUESTIONS}, {BM25} SELECT query_id, id, round(score, 6) AS score, rank FROM lex WHERE rank <= 10",
    "bm25_indexed": f"WITH {DOCS}, {QUESTIONS}, {BM25} SELECT query_id, id, round(score, 6) AS score, rank FROM lex WHERE rank <= 10",
    "bm25_index_refreshed": f"""WITH bad AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 0), toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1),
docs AS (SELECT doc_id AS id, CASE WHEN doc_id IN (SELECT doc_id FROM toxic) THEN text[1:40] || ' again ' || text[1:40] ELSE text END AS text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM bad)),
{QUESTIONS}, {BM25} SELECT query_id, id, round(score, 6) AS score, rank FROM lex WHERE rank <= 10""",
    "bm25_scoped": f"""WITH {DOCS}, {QUESTIONS}, {BM25}, own AS (SELECT s.* FROM scores s JOIN documents d ON d.doc_id = s.id AND d.source = 'src' || (s.query_id % 20)),
r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos, id) AS rank FROM own) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
    "dense_knn": f"WITH {EMBEDDED}, {DENSE} SELECT query_id, id, round(distance, 6) AS distance, rank FROM dense WHERE rank <= 10",
    "dense_knn_scoped": f"""WITH {EMBEDDED}, far AS (SELECT query_id, id, round(list_cosine_distance(q, v), 9) AS distance FROM qvecs JOIN vecs ON label = scope),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM far) SELECT query_id, id, round(distance, 6) AS distance, rank FROM r WHERE rank <= 10""",
    "distance_threshold": f"""WITH {EMBEDDED}, {DENSE}, u AS (SELECT query_id, id, distance FROM dense WHERE rank <= 50 UNION ALL SELECT item_id, -1, NULL FROM benchmark)
SELECT query_id, id, round(distance, 6) AS distance FROM u WHERE distance IS NULL OR distance <= {THRESHOLD}e0""",
    "embedding_dims_check": "SELECT count(*) AS n_vectors, count(DISTINCT len(embedding)) AS n_dims, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim, count(DISTINCT len(embedding)) = 1 AND min(len(embedding)) > 0 AS valid FROM embeddings",
    "embedding_arity_check": "WITH t AS (SELECT DISTINCT doc_id AS id, true AS x FROM documents), v AS (SELECT DISTINCT vec_id AS id, true AS y FROM embeddings) SELECT id, coalesce(x, false) AS has_text, coalesce(y, false) AS has_vector FROM t FULL JOIN v USING (id) WHERE x IS NULL OR y IS NULL",
    "rrf_fusion": f"WITH {hybrid(1000000)} SELECT query_id, id, round(score, 9) AS score, rank FROM fused",
    "rrf_fusion_nway": f"""WITH {PAIRED}, {BM25}, {DENSE}, near AS (SELECT * FROM dense WHERE rank <= 50), words AS (SELECT * FROM lex WHERE rank <= 50), back AS (SELECT query_id, id, 51 - rank AS rank FROM words),
{fused("fused", ["near", "words", "back"], "60")} SELECT query_id, id, round(score, 9) AS score, rank FROM fused WHERE rank <= 20""",
    "hybrid_search": f"WITH {hybrid(5)} SELECT query_id, id, {ROUNDED} FROM hybrid",
    "hybrid_search_threshold": f"WITH {hybrid(10, threshold=THRESHOLD)} SELECT query_id, id, {ROUNDED} FROM hybrid",
    "hybrid_search_rerank": f"""WITH {hybrid(50)}, s AS (SELECT h.*, CAST(len(list_intersect(list_distinct(q.ts), list_distinct(t.ts))) AS DOUBLE) AS rerank_score FROM hybrid h JOIN qtoks q USING (query_id) JOIN toks t USING (id)),
r AS (SELECT query_id, id, distance, score, rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rank FROM s) SELECT query_id, id, {ROUNDED}, rerank_score FROM r WHERE rank <= 5""",
    "hybrid_search_scoped": f"WITH {scoped_hybrid(5)} SELECT query_id, id, {ROUNDED} FROM hybrid",
    "dense_search_rerank": f"WITH {PAIRED}, {BM25}, {DENSE}, near AS (SELECT * FROM dense WHERE rank <= 50), {NEAR_AGAIN.format('near')} SELECT query_id, id, round(distance, 6) AS distance, rerank_score, rank FROM again WHERE rank <= 5",
    "ask_questions": f"""WITH {scoped_hybrid(3, SCOPED.replace("FROM benchmark)", "FROM benchmark UNION ALL SELECT item_id + 1000000, '?!' FROM benchmark)", 1).replace("END AS scope FROM benchmark)", "END AS scope FROM benchmark UNION ALL SELECT item_id + 1000000, NULL FROM benchmark)"))},
normal AS (SELECT query_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM asked),
ev AS (SELECT query_id, count(*) AS n, string_agg('[S' || rank || '] Document: d' || id || '; Page: ' || (id % 3 + 1) || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM hybrid JOIN docs USING (id) GROUP BY query_id),
said AS (SELECT query_id, n, 'of ' || ({len(PROMPT)} + length(context) + 12 + length(text)) || ' [S2], then [S9] and [S1][S2]' AS answer FROM ev JOIN normal USING (query_id)),
cites AS (SELECT query_id, string_agg('S' || rank || ':d' || id || ':' || (id % 3 + 1), ',' ORDER BY CASE rank WHEN 2 THEN 0 ELSE 1 END) AS citations FROM hybrid WHERE rank IN (1, 2) GROUP BY query_id)
SELECT a.query_id, coalesce(answer, '{REFUSAL.replace("'", "''")}') AS answer, coalesce(n, 0) AS n_sources, coalesce(citations, '') AS citations FROM asked a LEFT JOIN said USING (query_id) LEFT JOIN cites USING (query_id)""",
    "rerank": f"WITH {PAIRS}, r AS (SELECT query_id, id, s AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS rank FROM pairs) SELECT query_id, id, rank, rerank_score FROM r WHERE rank <= 10",
    "rerank_model": f"WITH {PAIRS}, r AS (SELECT query_id, id, s AS rerank_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS rank FROM pairs) SELECT query_id, id, rank, rerank_score FROM r WHERE rank <= 10",
    "embed_chunks": f"WITH {TURNS}, {NORMAL_PAGES}, {cut('clean', 40, 8)} SELECT document_id, page_number, chunk_index, CAST(length(text) AS DOUBLE) AS v0, CAST(len(regexp_extract_all(text, '\\S+')) AS DOUBLE) AS v1, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS v2 FROM cut",
    "chat_answers": "SELECT item_id AS query_id, regexp_replace(length(text) || ' [S1] ' || substr(text, 1, 9), '\\s+$', '') AS answer FROM benchmark",
    "rerank_head": f"WITH {PAIRS} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rank > 10, CASE WHEN rank <= 10 THEN s END DESC, rank) AS rank FROM pairs",
    "eval_ndcg": f"WITH {hybrid(100, 100)}, {metrics('hybrid')} SELECT query_id, round(ndcg10, 6) AS ndcg10 FROM m",
    "eval_recall": f"WITH {hybrid(100, 100)}, {metrics('hybrid')} SELECT query_id, round(recall10, 6) AS recall10, round(recall100, 6) AS recall100 FROM m",
    "eval_mrr": f"WITH {hybrid(100, 100)}, {metrics('hybrid')} SELECT query_id, round(mrr10, 6) AS mrr10 FROM m",
    "eval_summary": f"""WITH {hybrid(100, 100)}, {NEAR_AGAIN.format('near')}, runs AS (SELECT 'bm25' AS mode, query_id, id, rank FROM words UNION ALL SELECT 'dense', query_id, id, rank FROM near UNION ALL SELECT 'hybrid', query_id, id, rank FROM hybrid UNION ALL SELECT 'dense_rerank', query_id, id, rank FROM again),
modes AS (SELECT unnest(['bm25', 'dense', 'hybrid', 'dense_rerank']) AS mode), {metrics('runs', 'mode', 'modes')} SELECT mode, {MEANS} FROM m GROUP BY mode""",
    "eval_threshold_sweep": f"""WITH {PAIRED}, {DENSE}, {JUDGED}, near AS (SELECT * FROM dense WHERE rank <= 100), g AS (SELECT query_id, count(*) AS relevant FROM qrels GROUP BY query_id),
c AS (SELECT CAST(unnest({SWEEP}) AS DOUBLE) AS cutoff),
o AS (SELECT cutoff, g.query_id, relevant, count(n.id) AS kept, count(r.id) AS hits FROM g CROSS JOIN c LEFT JOIN near n ON n.query_id = g.query_id AND n.distance <= cutoff LEFT JOIN qrels r ON r.query_id = n.query_id AND r.id = n.id GROUP BY ALL)
SELECT cutoff, round(avg(kept), 6) AS mean_kept, round(avg(CASE WHEN kept > 0 THEN CAST(hits AS DOUBLE) / kept ELSE 0 END), 6) AS precision, round(avg(CAST(hits AS DOUBLE) / relevant), 6) AS recall100, round(avg(CASE WHEN kept = 0 THEN 1e0 ELSE 0 END), 6) AS empty_share FROM o GROUP BY cutoff""",
    "eval_rrf_sweep": f"""WITH {PAIRED}, {BM25}, {DENSE}, ks AS (SELECT unnest({RRF_CONSTANTS}) AS k), near AS (SELECT k, dense.* FROM dense, ks WHERE rank <= 100), words AS (SELECT k, lex.* FROM lex, ks WHERE rank <= 100),
{fused("fused", ["near", "words"], "k", "k, ")}, run AS (SELECT * FROM fused WHERE rank <= 100), {metrics('run', 'k', 'ks')} SELECT k, {MEANS} FROM m GROUP BY k""",
    "corpus_scan": r"""WITH r AS (SELECT 'd' || doc_id AS id, CASE doc_id % 3 WHEN 0 THEN trim(' ' || source) ELSE '' END AS title, CASE WHEN doc_id % 5 <> 0 THEN regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') ELSE '' END AS body FROM documents),
t AS (SELECT id, regexp_replace(CASE WHEN title <> '' THEN title || chr(10) || body ELSE body END, '^\s+|\s+$', '', 'g') AS text FROM r) SELECT * FROM t WHERE text <> ''""",
    "qrels_scan": "SELECT CAST(doc_id % 50 AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS id, max(quality + toxic) AS grade FROM labels WHERE quality + toxic > 0 GROUP BY ALL",
    "qrels_last_wins": "SELECT CAST(doc_id % 7 AS VARCHAR) AS query_id, CAST(doc_id % 5 AS VARCHAR) AS id, max_by(quality + 2 * toxic, doc_id) AS grade FROM labels WHERE quality + 2 * toxic > 0 GROUP BY ALL",
    "query_semi_join": "SELECT item_id AS query_id, text FROM benchmark WHERE item_id IN (SELECT doc_id FROM labels WHERE quality > 0)",
    "query_limit": "SELECT item_id AS query_id, text FROM benchmark ORDER BY CAST(item_id AS VARCHAR) LIMIT 25",
    "context_assembly": f"""WITH {hybrid(5)} SELECT query_id, count(*) AS n_sources, string_agg('[S' || rank || '] Document: ' || id || '; Page: 1' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM hybrid JOIN docs USING (id) GROUP BY query_id""",
    "citation_validate": f"WITH {ANSWERS.format(n='item_id % 4')}, {CITED} SELECT a.query_id, coalesce(string_agg(label, ',' ORDER BY pos), '') AS cited FROM answers a LEFT JOIN cited USING (query_id) GROUP BY a.query_id",
    "citation_lookup": f"WITH {DOCS}, {QUESTIONS}, {BM25}, {ANSWERS.format(n='5')}, {CITED}, o AS (SELECT query_id, label, row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1 AS position FROM cited) SELECT query_id, position, label AS source_id, id FROM o JOIN lex USING (query_id) WHERE rank <= 5 AND label = 'S' || rank",
    "no_evidence_questions": f"""WITH {DOCS}, asked AS (SELECT item_id AS query_id, text FROM benchmark UNION ALL SELECT item_id + 1000000, '?!' FROM benchmark), {BM25}
SELECT query_id, '{REFUSAL.replace("'", "''")}' AS answer FROM asked WHERE query_id NOT IN (SELECT query_id FROM lex)""",
    "validate_uploads": """WITH u AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'a.txt' WHEN doc_id % 17 = 1 THEN NULL ELSE 'd' || doc_id || '.PDF' END AS f, CASE doc_id % 5 WHEN 1 THEN 'text/plain' WHEN 2 THEN NULL WHEN 3 THEN '' ELSE 'application/x-pdf' END AS m,
CASE doc_id % 11 WHEN 3 THEN '' WHEN 4 THEN 'not ' || text ELSE '%PDF-' || text END AS c, CASE WHEN doc_id % 13 = 5 THEN 0 ELSE 25 END AS mb FROM documents)
SELECT doc_id, CASE WHEN f IS NULL OR NOT lower(f) LIKE '%.pdf' THEN 'extension' WHEN m <> '' AND m NOT IN ('application/pdf', 'application/x-pdf') THEN 'mime' WHEN coalesce(strlen(c), 0) = 0 THEN 'empty' WHEN strlen(c) > mb * 1024 * 1024 THEN 'size' WHEN NOT starts_with(c, '%PDF-') THEN 'signature' END AS reject_reason FROM u""",
    "extract_pages": r"""WITH f AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN doc_id % 11 = 3 THEN 'encrypted' WHEN doc_id % 13 = 5 THEN 'unreadable' END AS reason, CASE WHEN doc_id % 17 = 7 THEN '' ELSE coalesce(text, '') END AS text FROM documents),
l AS (SELECT document_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n, unnest(string_split(text, chr(10))) AS line FROM f WHERE reason IS NULL),
p AS (SELECT document_id, n AS page_number, regexp_replace(line, '^\s+|\s+$', '', 'g') AS text FROM l WHERE regexp_matches(line, '\S'))
SELECT document_id, page_number, text, NULL AS reject_reason FROM p UNION ALL
SELECT document_id, NULL, NULL, coalesce(reason, 'no_text') FROM f WHERE reason IS NOT NULL OR document_id NOT IN (SELECT document_id FROM p)""",
    "page_scan": rf"WITH {SPACED}, s AS (SELECT document_id, page_number, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS text FROM pages) SELECT * FROM s WHERE text <> ''",
    "missing_documents": "SELECT DISTINCT vec_id AS document_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)",
    "replace_document": f"""WITH {DOC_PAGES}, tox AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS document_id FROM labels WHERE toxic = 1), old_pages AS (SELECT * FROM pages ANTI JOIN tox USING (document_id)), new_pages AS (SELECT * FROM pages SEMI JOIN tox USING (document_id)),
{cut('old_pages', 450, 75, 'a')}, {cut('new_pages', 40, 8, 'b')} SELECT * FROM a UNION ALL SELECT * FROM b""",
    "all_chunks": f"WITH {TURNS}, {NORMAL_PAGES}, {cut('clean', 40, 8)} SELECT document_id || ':' || page_number || ':' || chunk_index AS chunk_id, document_id, page_number, chunk_index, text, CAST(NULL AS DOUBLE) AS distance FROM cut",
    "document_stats": f"""WITH {SPACED}, {NORMAL_PAGES}, {cut('clean', 40, 8)}, p AS (SELECT document_id, count(*) AS n_pages FROM clean GROUP BY document_id), c AS (SELECT document_id, count(*) AS n_chunks, sum(token_count) AS n_tokens FROM cut GROUP BY document_id)
SELECT document_id, coalesce(n_pages, 0) AS n_pages, coalesce(n_chunks, 0) AS n_chunks, CAST(coalesce(n_tokens, 0) AS BIGINT) AS n_tokens FROM (SELECT DISTINCT document_id FROM pages) LEFT JOIN p USING (document_id) LEFT JOIN c USING (document_id)""",
}
ORACLE_SQL["extract_pages_lateral"] = ORACLE_SQL["extract_pages"]
