"""Chunks as overlapping windows of words, in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


def chunks(pages: DataFrame, max_tokens: int = 450, overlap: int = 75, uncut: Column | None = None) -> DataFrame:
    """(document_id, page_number, chunk_index, text, token_count) of pages (document_id, page_number, text).

    Chunk i of a page has the words from i * (max_tokens - overlap) on; indexes start anew on each page. A page
    without words has no chunk. Rows where ``uncut`` holds stay one row without text, and all other columns stay then.
    """
    if max_tokens <= 0 or not 0 <= overlap < max_tokens:
        raise ValueError("max_tokens must be positive and overlap from 0 to below it")
    step = max_tokens - overlap
    n = F.size("ws")
    count = F.when(n == 0, 0).when(n <= max_tokens, 1).otherwise(1 + F.ceil((n - max_tokens) / step)).cast("int")
    start = F.col("chunk_index") * step
    part = F.slice("ws", start + 1, F.lit(max_tokens))
    more = [c for c in pages.columns if c not in ("document_id", "page_number", "text")] if uncut is not None else []
    stays = F.lit(False) if uncut is None else uncut
    rows = pages.select("document_id", "page_number", words(F.col("text")).alias("ws"), *more).where((n > 0) | stays)
    rows = rows.select("document_id", "page_number", "ws", *more, F.explode(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1)).alias("chunk_index"))
    text = F.array_join(part, " ")
    size = F.least(n - start, F.lit(max_tokens)).cast("int")
    if uncut is not None:
        text, size = F.when(~stays, text), F.when(~stays, size)
    return rows.select("document_id", "page_number", "chunk_index", text.alias("text"), size.alias("token_count"), *more)


def chunk_id(document_id: str = "document_id", page_number: str = "page_number", chunk_index: str = "chunk_index"):
    return F.concat_ws(":", document_id, page_number, chunk_index)
