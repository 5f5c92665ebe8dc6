"""From files to the rows of the chunk table, as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .documents import extracted_chunks, extraction
from .embedding import embedded


def fresh_chunks(files: DataFrame, load_extractor: Callable, load_client: Callable, max_tokens: int = 450, overlap: int = 75, batch_size: int = 64, model: str | None = None) -> DataFrame:
    """(document_id, page_number, chunk_index, text, token_count, reject_reason, embedding[, embedding_model]) of files
    (document_id, content): pages, chunks and vectors, and a row with its reason for each file that has no pages. Nothing is
    computed twice: who writes these rows measures them as they are written."""
    rows = embedded(extracted_chunks(extraction(files, load_extractor), max_tokens, overlap), load_client, batch_size)
    return rows if model is None else rows.withColumn("embedding_model", F.when(F.col("reject_reason").isNull(), F.lit(model)))
