"""Every operator as a query over the driver's tables. The SQL that checks each is in ``oracle``.

documents are the corpus (source is their owner), benchmark items the questions, conversations the pages of documents,
embeddings the stored vectors (label is their owner). A document or question has the vector of its number, if there is
one; without it, it is searched by words alone. Searches by vector take the rows whose vec_id is divisible by 50.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..errors import EncryptedPdfError
from ..functions.text import TOKEN, lexical_tokens, normalize_question, normalize_text
from ..operators import answer, chunking, containment, evaluate, fusion, lexical, rerank, retrieval, vector
from ..operators.ivf import IvfIndex
from ..operators.postings import PostingIndex
from ..session import workspace
from ..sources import beir, documents, embedding, tables

THRESHOLD = 0.75
SWEEP = [*evaluate.CUTOFFS, 0.7, 0.75, 0.8]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.read(spark, f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("owner"))


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector", F.col("owner").alias("scope"))


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """All documents, with a vector where they have one."""
    rows = _table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("owner"))
    return rows.join(vectors(spark, d).select("id", "vector"), "id", "left")


def asked(spark: SparkSession, d: str) -> DataFrame:
    """All questions, with the vector of the same number."""
    return questions(spark, d).join(vectors(spark, d).select(F.col("id").alias("query_id"), "vector"), "query_id", "left")


def scoped_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions that ask one source each, and some that ask all."""
    n = F.col("query_id")
    return asked(spark, d).withColumn("scope", F.when(n % 6 != 5, F.concat(F.lit("src"), (n % 20).cast("string"))))


def judgements(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, id, grade): documents that hold the question's text, graded 1 or 2."""
    return containment.containing(docs(spark, d), questions(spark, d)).withColumn("grade", (1 + F.col("id") % 2).cast("int"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("document_id"), (F.col("turn") + 1).cast("int").alias("page_number"), "text")


def spaced_turns(spark: SparkSession, d: str) -> DataFrame:
    """Pages with blank ones among them and white space round the others."""
    text = F.when((F.col("page_number") - 1) % 3 == 1, F.lit(" \n ")).otherwise(F.concat(F.lit(" "), "text", F.lit("\n")))
    return turns(spark, d).withColumn("text", text)


def document_pages(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), "text")


def tokenize(spark, d):
    return docs(spark, d).select("id", F.posexplode(lexical_tokens(F.col("text"))).alias("pos", "token"))


def normalize_texts(spark, d):
    rough = F.replace(F.replace(F.replace("text", F.lit(" of "), F.lit("  o\tf  ")), F.lit("\n"), F.lit(" \r\n\r\n \r ")), F.lit(". "), F.lit(".\r "))
    return docs(spark, d).select("id", normalize_text(F.concat(F.lit(" \t"), rough, F.lit("\n "))).alias("text"))


def normalize_questions(spark, d):
    rough = F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit(" \t ")), F.lit("\n"))
    return questions(spark, d).select("query_id", normalize_question(rough).alias("text"))


def chunk_documents(spark, d):
    return chunking.chunks(document_pages(spark, d), 450, 75)


def chunk_documents_small(spark, d):
    return chunking.chunks(document_pages(spark, d), 4, 1)


def document_chunks(spark, d):
    return documents.document_chunks(turns(spark, d), 40, 8)


def term_frequency(spark, d):
    return lexical.term_frequency(docs(spark, d))


def document_frequency(spark, d):
    return lexical.document_frequency(docs(spark, d)).withColumn("idf", F.round("idf", 9))


def index_stats(spark, d):
    return lexical.index_stats(docs(spark, d)).withColumn("avgdl", F.round("avgdl", 9))


def bm25_search(spark, d):
    return lexical.bm25(docs(spark, d), questions(spark, d), 10).withColumn("score", F.round("score", 6))


def bm25_scoped(spark, d):
    owners = _table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("owner"))
    own = questions(spark, d).withColumn("owner", F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string")))
    return lexical.bm25_scoped(docs(spark, d), own, owners, 10).withColumn("score", F.round("score", 6))


def bm25_indexed(spark, d):
    """The same search in an index that is built and kept."""
    index = PostingIndex(spark, workspace(spark, "index"))
    index.build(docs(spark, d))
    return index.search(questions(spark, d), 10).withColumn("score", F.round("score", 6))


def bm25_index_refreshed(spark, d):
    """A search after a refresh: of the documents that are toxic, other texts; those of low quality are gone."""
    index = PostingIndex(spark, workspace(spark, "index"))
    index.build(docs(spark, d))
    labels = _table(spark, d, "labels")
    gone = labels.where("quality = 0").select("doc_id").distinct()
    other = labels.where("toxic = 1").select("doc_id").distinct().join(gone, "doc_id", "left_anti")
    fresh = docs(spark, d).join(other.select(F.col("doc_id").alias("id")), "id", "left_semi").withColumn("text", F.concat(F.substring("text", 1, 40), F.lit(" again "), F.substring("text", 1, 40)))
    index.update(fresh, other.unionByName(gone).select(F.col("doc_id").alias("document_id")))
    return index.search(questions(spark, d), 10).withColumn("score", F.round("score", 6))


def dense_knn(spark, d):
    return vector.nearest(vectors(spark, d), query_vectors(spark, d), 10).withColumn("distance", F.round("distance", 6))


def dense_knn_scoped(spark, d):
    return vector.nearest(vectors(spark, d), query_vectors(spark, d), 10, scoped=True).withColumn("distance", F.round("distance", 6))


def dense_knn_ivf(spark, d):
    """Neighbours by an inverted file, which may miss some; distances are exact."""
    index = IvfIndex(spark, workspace(spark, "ivf"))
    index.build(vectors(spark, d))
    return index.search(query_vectors(spark, d).drop("scope"), 10).withColumn("distance", F.round("distance", 6))


def distance_threshold(spark, d):
    hits = vector.nearest(vectors(spark, d), query_vectors(spark, d), 50).select("query_id", "id", "distance")
    lexical_only = questions(spark, d).select("query_id", F.lit(-1).cast("bigint").alias("id"), F.lit(None).cast("double").alias("distance"))
    return vector.within(hits.unionByName(lexical_only), THRESHOLD).withColumn("distance", F.round("distance", 6))


def embedding_dims_check(spark, d):
    return vector.dimensions(vectors(spark, d))


def embedding_arity_check(spark, d):
    return vector.arity(docs(spark, d), vectors(spark, d))


def _lists(spark, d, depth=50):
    c, q = corpus(spark, d), asked(spark, d)
    return vector.nearest(c, q, depth), lexical.bm25(docs(spark, d), q, depth)


def rrf_fusion(spark, d):
    return fusion.fuse(list(_lists(spark, d)), 10).withColumn("score", F.round("score", 9))


def rrf_fusion_nway(spark, d):
    dense, lex = _lists(spark, d)
    back = lex.select("query_id", "id", (51 - F.col("rank")).alias("rank"))
    return fusion.fuse([dense, lex, back], 60, 20).withColumn("score", F.round("score", 9))


def _hybrid(spark, d, **kw):
    return retrieval.hybrid(corpus(spark, d), asked(spark, d), texts=docs(spark, d), **kw)


def hybrid_search(spark, d):
    return _hybrid(spark, d).withColumns({"distance": F.round("distance", 6), "score": F.round("score", 9)})


def hybrid_search_scoped(spark, d):
    out = retrieval.hybrid(corpus(spark, d), scoped_questions(spark, d), threshold=THRESHOLD, texts=docs(spark, d))
    return out.withColumns({"distance": F.round("distance", 6), "score": F.round("score", 9)})


def dense_search_rerank(spark, d):
    """Settings that fuse nothing and rerank neighbours."""
    config = EngineConfig(hybrid=False, rerank=True)
    out = retrieval.search(corpus(spark, d), asked(spark, d), config, 5, rerank.overlap_score(F.col("question"), F.col("text")))
    return out.withColumns({"distance": F.round("distance", 6)}).drop("score")


def ask_questions(spark, d):
    """Scoped questions, among them some that nothing answers, to a stand-in for the model."""
    pages = corpus(spark, d).withColumns({"document_id": F.concat(F.lit("d"), F.col("id").cast("string")), "page_number": (F.col("id") % 3 + 1).cast("int")})
    own = scoped_questions(spark, d).unionByName(questions(spark, d).select((F.col("query_id") + 1_000_000).alias("query_id"), F.lit("?!").alias("text")), allowMissingColumns=True)
    reply = lambda prompt: F.concat(F.lit("of "), F.length(prompt).cast("string"), F.lit(" [S2], then [S9] and [S1][S2]"))
    out = retrieval.ask(pages, own, reply, EngineConfig(distance_threshold=THRESHOLD), 3)
    told = F.array_join(F.transform("citations", lambda c: F.concat_ws(":", c["source_id"], c["document_id"], c["page_number"].cast("string"))), ",")
    return out.select("query_id", "answer", "n_sources", told.alias("citations"))


def hybrid_search_threshold(spark, d):
    return _hybrid(spark, d, threshold=THRESHOLD, top_k=10).withColumns({"distance": F.round("distance", 6), "score": F.round("score", 9)})


def hybrid_search_rerank(spark, d):
    out = _hybrid(spark, d, score=rerank.overlap_score(F.col("question"), F.col("text")))
    return out.withColumns({"distance": F.round("distance", 6), "score": F.round("score", 9)})


def _candidates(spark, d):
    found = lexical.bm25(docs(spark, d), questions(spark, d), 50).select("query_id", "id", "rank")
    return found.join(docs(spark, d), "id").join(questions(spark, d).withColumnRenamed("text", "question"), "query_id")


def reranked(spark, d):
    return rerank.rerank(_candidates(spark, d), rerank.overlap_score(F.col("question"), F.col("text")), 10).select("query_id", "id", "rank", "rerank_score")


def rerank_head(spark, d):
    return rerank.rerank_head(_candidates(spark, d), rerank.overlap_score(F.col("question"), F.col("text")), 10).select("query_id", "id", "rank")


def overlap_model() -> Callable[[list[tuple[str, str]]], list[float]]:
    """A stand-in for a cross-encoder: distinct tokens of the question that the text has."""
    tokens = lambda t: set(re.findall(TOKEN, (t or "").lower()))
    return lambda pairs: [float(len(tokens(q) & tokens(t))) for q, t in pairs]


def rerank_model(spark, d):
    return rerank.rerank(_candidates(spark, d), rerank.scorer(overlap_model)(F.col("question"), F.col("text")), 10).select("query_id", "id", "rank", "rerank_score")


def counting_client() -> Callable[[list[str]], list[list[float]]]:
    """A stand-in for an embedding model: characters, words and letters e."""
    return lambda texts: [[float(len(t)), float(len(t.split())), float(t.count("e"))] for t in texts]


def embed_chunks(spark, d):
    rows = embedding.embedded(document_chunks(spark, d), counting_client, 16)
    return rows.select("document_id", "page_number", "chunk_index", *(F.get("embedding", F.lit(k)).cast("double").alias(f"v{k}") for k in range(3)))


def chat_answers(spark, d):
    """Prompts to a stand-in for a chat model."""
    return answer.answered(questions(spark, d).withColumnRenamed("text", "prompt"), lambda: lambda p: f" {len(p)} [S1] {p[:9]}\n")


def _metrics(spark, d):
    return evaluate.per_query(_hybrid(spark, d, top_k=100, depth=100), judgements(spark, d))


def eval_ndcg(spark, d):
    return _metrics(spark, d).select("query_id", F.round("ndcg10", 6).alias("ndcg10"))


def eval_recall(spark, d):
    return _metrics(spark, d).select("query_id", F.round("recall10", 6).alias("recall10"), F.round("recall100", 6).alias("recall100"))


def eval_mrr(spark, d):
    return _metrics(spark, d).select("query_id", F.round("mrr10", 6).alias("mrr10"))


def eval_summary(spark, d):
    run = evaluate.runs(*_lists(spark, d, 100), 10, 100, rerank.overlap_score(F.col("question"), F.col("text")), docs(spark, d), questions(spark, d))
    modes = spark.createDataFrame([(m,) for m in ("bm25", "dense", "hybrid", "dense_rerank")], "mode string")
    return evaluate.summary(evaluate.per_query(run, judgements(spark, d), ("mode",), modes), ("mode",))


def eval_threshold_sweep(spark, d):
    hits = vector.nearest(corpus(spark, d), asked(spark, d), 100)
    return evaluate.threshold_sweep(hits, judgements(spark, d), SWEEP)


def eval_rrf_sweep(spark, d):
    run = fusion.fuse_for(list(_lists(spark, d, 100)), evaluate.RRF_CONSTANTS, 100)
    ks = spark.createDataFrame([(k,) for k in evaluate.RRF_CONSTANTS], "k int")
    return evaluate.summary(evaluate.per_query(run, judgements(spark, d), ("k",), ks), ("k",))


def corpus_scan(spark, d):
    n = F.col("doc_id")
    title = F.when(n % 3 == 0, F.concat(F.lit(" "), "source")).when(n % 3 == 1, F.lit(" "))
    records = _table(spark, d, "documents").select(F.concat(F.lit("d"), n.cast("string")).alias("_id"), title.alias("title"), F.when(n % 5 != 0, F.col("text")).alias("text"))
    return beir.corpus_rows(records)


def qrels_scan(spark, d):
    records = _table(spark, d, "labels").select((F.col("doc_id") % 50).cast("string").alias("query_id"), F.col("doc_id").cast("string").alias("id"), (F.col("quality") + F.col("toxic")).cast("int").alias("grade"))
    return beir.qrels_rows(records)


def qrels_last_wins(spark, d):
    """Judgements of which the last by their number counts; those of grade 0 do not."""
    n = F.col("doc_id")
    records = _table(spark, d, "labels").select((n % 7).cast("string").alias("query_id"), (n % 5).cast("string").alias("id"), (F.col("quality") + 2 * F.col("toxic")).cast("int").alias("grade"), n.alias("line"))
    return beir.qrels_rows(records)


def query_semi_join(spark, d):
    qrels = _table(spark, d, "labels").where("quality > 0").select(F.col("doc_id").alias("query_id"))
    return beir.judged_queries(questions(spark, d), qrels)


def query_limit(spark, d):
    return beir.first_queries(questions(spark, d), 25)


def context_assembly(spark, d):
    found = _hybrid(spark, d).join(docs(spark, d), "id")
    return answer.contexts(found.select("query_id", "rank", F.col("id").alias("document_id"), F.lit(1).alias("page_number"), "text"))


def _answers(spark, d):
    q = F.col("query_id")
    said = F.concat("text", F.lit(" [S2] and [S1][S2] [S9] [S1, S2] [S01] [S"), (q % 7).cast("string"), F.lit("]"))
    return questions(spark, d).select("query_id", said.alias("answer"), (q % 4).cast("int").alias("n_sources"))


def citation_validate(spark, d):
    cited = answer.cited(F.col("answer"), F.col("n_sources"))
    return _answers(spark, d).select("query_id", F.array_join(cited, ",").alias("cited"))


def citation_lookup(spark, d):
    answers = _answers(spark, d).select("query_id", answer.cited(F.col("answer"), F.lit(5)).alias("cited"))
    return answer.citations(answers, lexical.bm25(docs(spark, d), questions(spark, d), 5))


def no_evidence_questions(spark, d):
    strange = questions(spark, d).select((F.col("query_id") + 1_000_000).alias("query_id"), F.lit("?!").alias("text"))
    both = questions(spark, d).unionByName(strange)
    return answer.refusals(both, lexical.bm25(docs(spark, d), both, 5))


def validate_uploads(spark, d):
    n = F.col("doc_id")
    name = F.when(n % 7 == 0, F.lit("a.txt")).when(n % 17 == 1, F.lit(None)).otherwise(F.concat(F.lit("d"), n.cast("string"), F.lit(".PDF")))
    mime = F.when(n % 5 == 1, F.lit("text/plain")).when(n % 5 == 2, F.lit(None)).when(n % 5 == 3, F.lit("")).otherwise(F.lit("application/x-pdf"))
    content = F.when(n % 11 == 3, F.lit("")).when(n % 11 == 4, F.concat(F.lit("not "), "text")).otherwise(F.concat(F.lit("%PDF-"), "text")).cast("binary")
    reason = documents.reject_reason(name, mime, content, F.when(n % 13 == 5, 0).otherwise(25))
    return _table(spark, d, "documents").select("doc_id", reason.alias("reject_reason"))


def extract_pages(spark, d):
    """Texts as files whose lines are pages; some are encrypted, some cannot be read."""
    n = F.col("doc_id")
    content = F.when(n % 11 == 3, F.lit("encrypted")).when(n % 13 == 5, F.lit("broken")).when(n % 17 == 7, F.lit(" \n ")).otherwise(F.col("text"))
    files = _table(spark, d, "documents").select(n.cast("string").alias("document_id"), content.cast("binary").alias("content"))
    return documents.extraction(files, line_pages)


def extract_pages_lateral(spark, d):
    """The same by a table function in SQL."""
    n = F.col("doc_id")
    content = F.when(n % 11 == 3, F.lit("encrypted")).when(n % 13 == 5, F.lit("broken")).when(n % 17 == 7, F.lit(" \n ")).otherwise(F.col("text"))
    files = _table(spark, d, "documents").select(n.cast("string").alias("document_id"), content.cast("binary").alias("content"))
    spark.udtf.register("quern_line_pages", documents.page_table(line_pages))
    return spark.sql("SELECT f.document_id, p.* FROM {files} f, LATERAL quern_line_pages(f.content) p", files=files)


def line_pages() -> Callable[[bytes], list[str]]:
    """An extractor for texts whose lines are pages."""

    def extract(content: bytes) -> list[str]:
        text = content.decode()
        if text == "encrypted":
            raise EncryptedPdfError(text)
        if text == "broken":
            raise ValueError(text)
        return text.split("\n")

    return extract


def page_scan(spark, d):
    return documents.page_scan(spaced_turns(spark, d))


def missing_documents(spark, d):
    requested = vectors(spark, d).select(F.col("id").alias("document_id"))
    return documents.missing(requested, _table(spark, d, "labels").select(F.col("doc_id").alias("document_id")))


def replace_document(spark, d):
    toxic = _table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("document_id")).distinct()
    pages = document_pages(spark, d)
    return documents.replaced(chunking.chunks(pages), chunking.chunks(pages.join(toxic, "document_id", "left_semi"), 40, 8))


def all_chunks(spark, d):
    return documents.all_chunks(document_chunks(spark, d))


def document_stats(spark, d):
    pages = spaced_turns(spark, d)
    return documents.document_stats(pages, documents.document_chunks(pages, 40, 8))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "tokenize": tokenize,
    "normalize_text": normalize_texts,
    "normalize_question": normalize_questions,
    "chunk_documents": chunk_documents,
    "chunk_documents_small": chunk_documents_small,
    "document_chunks": document_chunks,
    "term_frequency": term_frequency,
    "document_frequency": document_frequency,
    "index_stats": index_stats,
    "bm25_search": bm25_search,
    "bm25_scoped": bm25_scoped,
    "bm25_indexed": bm25_indexed,
    "bm25_index_refreshed": bm25_index_refreshed,
    "dense_knn": dense_knn,
    "dense_knn_scoped": dense_knn_scoped,
    "dense_knn_ivf": dense_knn_ivf,
    "distance_threshold": distance_threshold,
    "embedding_dims_check": embedding_dims_check,
    "embedding_arity_check": embedding_arity_check,
    "rrf_fusion": rrf_fusion,
    "rrf_fusion_nway": rrf_fusion_nway,
    "hybrid_search": hybrid_search,
    "hybrid_search_threshold": hybrid_search_threshold,
    "hybrid_search_rerank": hybrid_search_rerank,
    "hybrid_search_scoped": hybrid_search_scoped,
    "dense_search_rerank": dense_search_rerank,
    "ask_questions": ask_questions,
    "rerank": reranked,
    "rerank_head": rerank_head,
    "rerank_model": rerank_model,
    "embed_chunks": embed_chunks,
    "chat_answers": chat_answers,
    "eval_ndcg": eval_ndcg,
    "eval_recall": eval_recall,
    "eval_mrr": eval_mrr,
    "eval_summary": eval_summary,
    "eval_threshold_sweep": eval_threshold_sweep,
    "eval_rrf_sweep": eval_rrf_sweep,
    "corpus_scan": corpus_scan,
    "qrels_scan": qrels_scan,
    "qrels_last_wins": qrels_last_wins,
    "query_semi_join": query_semi_join,
    "query_limit": query_limit,
    "context_assembly": context_assembly,
    "citation_validate": citation_validate,
    "citation_lookup": citation_lookup,
    "no_evidence_questions": no_evidence_questions,
    "validate_uploads": validate_uploads,
    "extract_pages": extract_pages,
    "extract_pages_lateral": extract_pages_lateral,
    "page_scan": page_scan,
    "missing_documents": missing_documents,
    "replace_document": replace_document,
    "all_chunks": all_chunks,
    "document_stats": document_stats,
}
