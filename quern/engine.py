"""The engine as its settings wire it: a chunk store, the caller's models, and what is asked of both."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import EngineConfig, check_request
from .errors import EmbeddingError
from .operators import answer, rerank, retrieval
from .operators.postings import PostingIndex
from .session import workspace
from .sources.documents import store_uploads
from .sources.embedding import embedded
from .sources.indexing import fresh_chunks
from .sources.store import ChunkStore

#: Results that a search and an answer can ask for.
MOST_RESULTS, MOST_SOURCES = 20, 10
CHUNK = ("chunk_id", "document_id", "page_number", "chunk_index", "text")


class Engine:
    """Models are functions that load one: an embedding client, and perhaps a scorer of pairs and a chat model (called with
    ``temperature`` if its loader takes that). With an ``index``, words are searched in it instead of in the texts, after it
    has been brought to the store's version.

    Questions are (query_id, text[, scope]); a scope is a document_id, null is none. Everything is a batch: one plan
    answers all questions.
    """

    def __init__(self, store: ChunkStore, client: Callable, config: EngineConfig | None = None, scorer: Callable | None = None, chat: Callable | None = None, index: PostingIndex | None = None):
        self.store, self.client, self.config, self.scorer, self.chat, self.postings = store, client, config or EngineConfig(), scorer, chat, index
        if self.config.rerank and scorer is None:
            raise ValueError("reranking needs a scorer")

    def upload(self, uploads: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
        """``store_uploads`` with the settings' greatest size."""
        return store_uploads(uploads, root, self.config.max_upload_mb)

    def index(self, files: DataFrame, extractor: Callable) -> list:
        """Replace the documents of files (document_id, content) by what they hold now; the rows of those without pages.
        One plan extracts, cuts, embeds, measures and writes."""
        c = self.config
        made = self.store.replace(fresh_chunks(files, extractor, self.client, c.chunk_tokens, c.chunk_overlap, c.embedding_batch, c.embedding_model))
        return self.store.rejects(made).collect()

    def rebuild(self, files: DataFrame, extractor: Callable) -> list:
        """Drop everything that is stored and index these files."""
        c = self.config
        made = self.store.rebuild(fresh_chunks(files, extractor, self.client, c.chunk_tokens, c.chunk_overlap, c.embedding_batch, c.embedding_model))
        return self.store.rejects(made).collect()

    def corpus(self) -> DataFrame:
        """The current version's chunks by chunk_id, with vector and owner, and their columns."""
        name = F.concat_ws(":", "document_id", "page_number", "chunk_index")
        return self.store.read().select(name.alias("id"), F.col("embedding").alias("vector"), F.col("document_id").alias("owner"), name.alias("chunk_id"), "document_id", "page_number", "chunk_index", "text")

    def questions(self, questions: DataFrame) -> DataFrame:
        """With normalised texts and vectors; a text of no or too many characters is an error. They are written down, as
        a search reads them several times, and embedded once."""
        stored = self.store.manifest(self.store.version())
        if stored.model not in (None, self.config.embedding_model):
            raise EmbeddingError(f"questions would have vectors of {self.config.embedding_model}, the stored ones are of {stored.model}")
        fits = F.length("text").between(1, 2000)
        text = F.when(fits, F.col("text")).otherwise(F.raise_error(F.lit("a question has 1 to 2000 characters")).cast("string"))
        rows = questions.withColumn("text", retrieval.normalize_question(text))
        asked = embedded(rows, self.client, self.config.embedding_batch).withColumnRenamed("embedding", "vector")
        path = workspace(self.store.spark, "asked")
        asked.write.parquet(path)
        return self.store.spark.read.schema(asked.schema).parquet(path)

    def _score(self):
        return None if self.scorer is None else rerank.scorer(self.scorer)(F.col("question"), F.col("text"))

    def _words(self) -> Callable | None:
        """A search by words in the kept index, if there is one."""
        if self.postings is None:
            return None
        name = F.concat_ws(":", "document_id", "page_number", "chunk_index")
        self.postings.sync(self.store, lambda rows: rows.select(name.alias("id"), "text", "document_id", F.col("document_id").alias("owner")))
        return self.postings.search

    def search(self, questions: DataFrame, top_k: int = 5) -> DataFrame:
        """(query_id, rank, distance, score, rerank_score, chunk_id, document_id, page_number, chunk_index, text)."""
        check_request("-", top_k, MOST_RESULTS)
        corpus = self.corpus()
        found = retrieval.search(corpus, self.questions(questions), self.config, top_k, self._score(), self._words())
        return found.join(corpus.select("id", *CHUNK), "id").select("query_id", "rank", "distance", "score", "rerank_score", *CHUNK)

    def ask(self, questions: DataFrame, top_k: int = 5) -> DataFrame:
        """(query_id, answer, n_sources, citations) by ``retrieval.ask`` with the chat model."""
        check_request("-", top_k, MOST_SOURCES)
        if self.chat is None:
            raise ValueError("answers need a chat model")
        chat = partial(self.chat, temperature=self.config.temperature) if "temperature" in inspect.signature(self.chat).parameters else self.chat
        return retrieval.ask(self.corpus(), self.questions(questions), answer.chat(chat), self.config, top_k, self._score(), self._words())


def responses(found: DataFrame) -> DataFrame:
    """(query_id, response): search results (query_id, rank, ...) as one JSON document a question, with their number."""
    rest = [c for c in found.columns if c != "query_id"]
    rows = F.array_sort(F.collect_list(F.struct("rank", *(c for c in rest if c != "rank"))))
    whole = found.groupBy("query_id").agg(F.count("*").alias("result_count"), rows.alias("results"))
    return whole.select("query_id", F.to_json(F.struct("query_id", "result_count", "results")).alias("response"))
