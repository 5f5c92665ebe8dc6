"""Search: dense neighbours and BM25, fused, looked up and perhaps reranked; and answers from what it finds.

A corpus is (id, text, vector[, owner]), questions are (query_id, text, vector[, scope]). Documents without a vector can
be found by their words, questions without one too. A scope names the owner whose documents count; null is no scope.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import normalize_question
from .answer import REFUSAL, cited, contexts
from .fusion import fuse
from .lexical import bm25, bm25_scoped
from .rerank import rerank
from .vector import nearest, within

#: A search by words: questions (query_id, text[, owner]), how many, k1 and b to (query_id, id, score, rank).
Words = Callable[[DataFrame, int, float, float], DataFrame]


def depth_for(top_k: int, candidate_depth: int, deep: bool) -> int:
    """Candidates to look at: more than ``top_k`` only if fusion or reranking follows."""
    return max(candidate_depth, top_k) if deep else top_k


def hybrid(corpus: DataFrame, questions: DataFrame, top_k: int = 5, depth: int = 50, k: int = 10, threshold: float | None = None, score: Column | None = None, k1: float = 0.9, b: float = 0.4, words: Words | None = None, texts: DataFrame | None = None) -> DataFrame:
    """(query_id, id, distance, score, rank[, rerank_score]), only of the question's scope if questions have one. ``words``
    searches by words in place of a scan of the texts. ``texts`` (id, text) are those of the corpus; where its vectors are
    joined to them, they need not go through that join.

    The threshold applies to dense hits before fusion, so a document beyond it can come back through BM25; its distance
    is then null. ``score`` (of columns question and text) reranks the fused candidates.
    """
    deep, scoped = depth_for(top_k, depth, True), "scope" in questions.columns
    asked = questions.withColumn("text", normalize_question(F.col("text")))
    dense = within(nearest(corpus, asked, deep, scoped), threshold)
    texts = corpus.select("id", "text") if texts is None else texts
    owned = asked.withColumnRenamed("scope", "owner") if scoped else asked
    if words is not None:
        lexical = words(owned, deep, k1, b)
    elif scoped:
        lexical = bm25_scoped(texts, owned, corpus.select("id", "owner"), deep, k1, b)
    else:
        lexical = bm25(texts, asked, deep, k1, b)
    out = fuse([dense, lexical], k, deep if score is not None else top_k, ("distance",))
    return out if score is None else _reranked(out, texts, asked, score, top_k).select("query_id", "id", "distance", "score", "rank", "rerank_score")


def _reranked(found: DataFrame, texts: DataFrame, asked: DataFrame, score: Column, top_k: int) -> DataFrame:
    paired = found.join(texts, "id").join(asked.select("query_id", F.col("text").alias("question")), "query_id")
    return rerank(paired, score, top_k)


def dense_only(corpus: DataFrame, questions: DataFrame, top_k: int = 5, threshold: float | None = None, depth: int = 50, score: Column | None = None) -> DataFrame:
    """(query_id, id, distance, rank[, rerank_score]): neighbours alone, perhaps reranked."""
    asked = questions.withColumn("text", normalize_question(F.col("text"))) if "text" in questions.columns else questions
    found = within(nearest(corpus, asked, depth_for(top_k, depth, score is not None), "scope" in questions.columns), threshold)
    return found if score is None else _reranked(found, corpus.select("id", "text"), asked, score, top_k).select("query_id", "id", "distance", "rank", "rerank_score")


def search(corpus: DataFrame, questions: DataFrame, config: EngineConfig, top_k: int = 5, score: Column | None = None, words: Words | None = None) -> DataFrame:
    """(query_id, id, distance, score, rerank_score, rank) as the settings want it: fused or dense alone, cut by distance or
    not, reranked or not (``score`` is needed for that). What a way of searching lacks is null."""
    if config.rerank and score is None:
        raise ValueError("reranking needs a score")
    score = score if config.rerank else None
    if config.hybrid:
        found = hybrid(corpus, questions, top_k, config.candidate_depth, config.rrf_k, config.distance_threshold, score, config.k1, config.b, words)
    else:
        found = dense_only(corpus, questions, top_k, config.distance_threshold, config.candidate_depth, score).withColumn("score", F.lit(None).cast("double"))
    if score is None:
        found = found.withColumn("rerank_score", F.lit(None).cast("double"))
    return found.select("query_id", "id", "distance", "score", "rerank_score", "rank")


LEAD = "Answer from these sources alone and name each that you use by its label, such as [S1].\n\n"


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit(LEAD), context, F.lit("\n\nQuestion: "), question)


def ask(corpus: DataFrame, questions: DataFrame, reply: Callable[[Column], Column], config: EngineConfig | None = None, top_k: int = 5, score: Column | None = None, words: Words | None = None) -> DataFrame:
    """(query_id, answer, n_sources, citations) of every question: search, evidence, model, citations.

    The corpus has document_id and page_number besides. ``reply`` makes an answer of a prompt, such as ``answer.chat`` with
    a model. Citations are (source_id, id, document_id, page_number) in the order of the answer, of sources that there
    are. Without evidence no model is asked, and the answer is the refusal.
    """
    asked = questions.withColumn("text", normalize_question(F.col("text")))
    found = search(corpus, asked, config or EngineConfig(), top_k, score, words).select("query_id", "id", "rank")
    sources = found.join(corpus.select("id", "document_id", "page_number", "text"), "id")
    given = contexts(sources, ("id", "document_id", "page_number")).join(asked.select("query_id", "text"), "query_id")
    answers = given.select("query_id", "n_sources", "sources", reply(prompt(F.col("text"), F.col("context"))).alias("answer"))
    # labels S1, S2, ... are the places of the sources, which stand by rank
    named = lambda label: F.element_at("sources", F.substring(label, 2, 10).cast("int"))
    one = lambda label: F.struct(label.alias("source_id"), *(named(label)[c].alias(c) for c in ("id", "document_id", "page_number")))
    answers = answers.withColumn("citations", F.transform(cited(F.col("answer"), F.col("n_sources")), one))
    out = questions.select("query_id").join(answers, "query_id", "left")
    none = F.array().cast(answers.schema["citations"].dataType)
    return out.select("query_id", F.coalesce("answer", F.lit(REFUSAL)).alias("answer"), F.coalesce("n_sources", F.lit(0)).cast("bigint").alias("n_sources"), F.coalesce("citations", none).alias("citations"))
