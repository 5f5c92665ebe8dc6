"""Continuous ingest: files that arrive in a folder become chunks in the store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.indexing import fresh_chunks
from ..sources.store import ChunkStore


def ingest_stream(spark: SparkSession, folder: str, store: ChunkStore, checkpoint: str, load_extractor: Callable, load_client: Callable, max_tokens: int = 450, overlap: int = 75) -> StreamingQuery:
    """Each micro-batch of new files replaces its documents in a new version; a repeated batch replaces them again, so
    a restart leaves no doubles. Files without pages go to the table ``<root>/rejects`` with their reasons. Runs over all
    files there are and ends."""
    files = spark.readStream.format("binaryFile").schema(spark.read.format("binaryFile").load(folder).schema).load(folder)
    named = files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("document_id"), "content")

    def put(batch: DataFrame, number: int) -> None:
        made = store.replace(fresh_chunks(batch, load_extractor, load_client, max_tokens, overlap))
        store.rejects(made).write.mode("overwrite").parquet(f"{store.root}/rejects/batch={number}")

    return named.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
