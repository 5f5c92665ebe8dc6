"""Uploads, pages and chunks. The table that keeps chunks is in ``store``."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..errors import EncryptedPdfError, MissingDocumentError
from ..functions.text import normalize_text, stripped
from ..operators.chunking import chunk_id, chunks

MIME_TYPES = ("application/pdf", "application/x-pdf")
SIGNATURE = b"%PDF-"


def reject_reason(filename: Column, content_type: Column, content: Column, max_mb: Column) -> Column:
    """Why an upload is rejected, by the first check that fails, or null: extension, mime, empty, size, signature."""
    size = F.coalesce(F.octet_length(content), F.lit(0))
    named = F.coalesce(F.lower(filename).endswith(".pdf"), F.lit(False))
    return (
        F.when(~named, "extension")
        .when((F.coalesce(content_type, F.lit("")) != "") & ~content_type.isin(*MIME_TYPES), "mime")
        .when(size == 0, "empty")
        .when(size > max_mb.cast("bigint") * 1024 * 1024, "size")
        .when(~content.startswith(F.lit(SIGNATURE)), "signature")
    )


def validated(uploads: DataFrame, max_mb: int = 25) -> tuple[DataFrame, DataFrame]:
    """Accepted uploads with a new document_id, and rejected ones with their reason."""
    marked = uploads.withColumn("reject_reason", reject_reason(F.col("filename"), F.col("content_type"), F.col("content"), F.lit(max_mb)))
    return marked.where("reject_reason is null").drop("reject_reason").withColumn("document_id", F.expr("uuid()")), marked.where("reject_reason is not null")


def store_uploads(uploads: DataFrame, root: str, max_mb: int = 25) -> tuple[DataFrame, DataFrame]:
    """Write accepted uploads to ``<root>/accepted`` and the others, without their bytes, to ``<root>/rejected``; both tables.

    One pass over the uploads, whose ids are drawn once: the table of all is read again for either part.
    """
    spark = uploads.sparkSession
    reason = reject_reason(F.col("filename"), F.col("content_type"), F.col("content"), F.lit(max_mb))
    marked = uploads.select("filename", "content_type", "content", F.coalesce(F.octet_length("content"), F.lit(0)).alias("size"), reason.alias("reject_reason"))
    kept = marked.withColumn("content", F.when(F.col("reject_reason").isNull(), F.col("content"))).withColumn("document_id", F.when(F.col("reject_reason").isNull(), F.expr("uuid()")))
    state = F.when(F.col("reject_reason").isNull(), "accepted").otherwise("rejected").alias("state")
    kept.select("*", state).write.mode("append").partitionBy("state").parquet(root)
    stored = spark.read.schema("filename string, content_type string, content binary, size int, reject_reason string, document_id string, state string").parquet(root)
    return stored.where("state = 'accepted'").select("document_id", "filename", "content"), stored.where("state = 'rejected'").select("filename", "content_type", "size", "reject_reason")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(document_id, path, content) of a folder of files named by document id."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1).alias("document_id"), "path", "content")


EXTRACTED = "document_id string, page_number int, text string, reject_reason string"


def page_rows(extract: Callable[[bytes], list[str]], content: bytes | None) -> list[tuple[int | None, str | None, str | None]]:
    """(page_number, text, reject_reason) of one file."""
    try:
        texts = [(t or "").strip() for t in extract(bytes(content))]
    except EncryptedPdfError:
        return [(None, None, "encrypted")]
    except Exception:
        return [(None, None, "unreadable")]
    return [(n, t, None) for n, t in enumerate(texts, 1) if t] or [(None, None, "no_text")]


def page_table(load: Callable[[], Callable[[bytes], list[str]]]):
    """A table function pages(content) to call laterally from SQL, with the rows of ``page_rows``:

        spark.udtf.register("pages", page_table(load))
        SELECT f.document_id, p.* FROM files f, LATERAL pages(f.content) p

    Anything but one binary argument is an error when the query is analysed. The extractor is loaded once a task.
    """

    class Pages:
        def __init__(self) -> None:
            self.extract = None

        @staticmethod
        def analyze(content: AnalyzeArgument) -> AnalyzeResult:
            if not isinstance(content.dataType, BinaryType):
                raise ValueError(f"pages needs the bytes of a file, not {content.dataType.simpleString()}")
            return AnalyzeResult(StructType().add("page_number", IntegerType()).add("text", StringType()).add("reject_reason", StringType()))

        def eval(self, content: bytes) -> Iterator[tuple]:
            if self.extract is None:
                self.extract = load()
            yield from page_rows(self.extract, content)

    return F.udtf(Pages)


def extraction(files: DataFrame, load: Callable[[], Callable[[bytes], list[str]]]) -> DataFrame:
    """(document_id, page_number, text, reject_reason) by a page extractor that the caller brings: bytes to the texts of all
    pages.

    Pages are numbered from 1 as they stand in the file; blank ones go, their numbers stay taken. A file is one row
    without pages and with its reason where the extractor raises ``EncryptedPdfError`` (encrypted) or any other error
    (unreadable; a page that fails fails its document), or where no page has text (no_text). One bad file ends no job.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = None
        for frame in frames:
            if len(frame) and extract is None:
                extract = load()
            rows = [(d, *r) for d, c in zip(frame["document_id"], frame["content"], strict=True) for r in page_rows(extract, c)]
            out = pd.DataFrame(rows, columns=["document_id", "page_number", "text", "reject_reason"])
            yield out.astype({"page_number": "Int32"})

    return files.select("document_id", "content").mapInPandas(run, EXTRACTED)


def extracted(files: DataFrame, load: Callable[[], Callable[[bytes], list[str]]]) -> DataFrame:
    """(document_id, page_number, text) where every file must have pages: the first that has none is an error."""
    told = F.concat_ws(" ", "document_id", "reject_reason")
    rows = extraction(files, load)
    checked = F.when(F.col("reject_reason").isNull(), F.col("page_number")).otherwise(F.raise_error(F.concat(F.lit("no pages: "), told)).cast("int"))
    return rows.select("document_id", checked.alias("page_number"), "text")


def page_scan(pages: DataFrame) -> DataFrame:
    """Pages (document_id, page_number, text) stripped, without the blank ones; numbers stay."""
    text = stripped(F.coalesce(F.col("text"), F.lit("")))
    return pages.select("document_id", F.col("page_number").cast("int").alias("page_number"), text.alias("text")).where(F.length("text") > 0)


def document_chunks(pages: DataFrame, max_tokens: int = 450, overlap: int = 75) -> DataFrame:
    """Pages to chunks: blank pages dropped, text normalised, windows cut."""
    scanned = page_scan(pages)
    return chunks(scanned.withColumn("text", normalize_text(F.col("text"))), max_tokens, overlap)


def extracted_chunks(rows: DataFrame, max_tokens: int = 450, overlap: int = 75) -> DataFrame:
    """``document_chunks`` of what ``extraction`` gives, in one pass: rows with a reject_reason stay as they are."""
    reason = F.col("reject_reason")
    text = F.when(reason.isNull(), normalize_text(stripped(F.coalesce("text", F.lit("")))))
    return chunks(rows.select("document_id", "page_number", text.alias("text"), "reject_reason"), max_tokens, overlap, reason.isNotNull()).withColumn("chunk_index", F.when(reason.isNull(), F.col("chunk_index")))


def missing(requested: DataFrame, stored: DataFrame) -> DataFrame:
    """Requested document_ids that no stored row has."""
    return requested.select("document_id").distinct().join(stored.select("document_id"), "document_id", "left_anti")


def require(requested: DataFrame, stored: DataFrame) -> None:
    if lost := [r.document_id for r in missing(requested, stored).limit(10).collect()]:
        raise MissingDocumentError(f"not stored: {lost}")


def replaced(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The table with all rows of the documents in ``fresh`` exchanged for its rows."""
    return stored.join(fresh.select("document_id").distinct(), "document_id", "left_anti").unionByName(fresh)


def all_chunks(stored: DataFrame) -> DataFrame:
    return stored.select(chunk_id().alias("chunk_id"), "document_id", "page_number", "chunk_index", "text", F.lit(None).cast("double").alias("distance"))


def document_stats(pages: DataFrame, cut: DataFrame) -> DataFrame:
    """(document_id, n_pages, n_chunks, n_tokens); a document whose pages are all blank has zeros."""
    n = page_scan(pages).groupBy("document_id").agg(F.count("*").alias("n_pages"))
    m = cut.groupBy("document_id").agg(F.count("*").alias("n_chunks"), F.sum("token_count").alias("n_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return pages.select("document_id").distinct().join(n, "document_id", "left").join(m, "document_id", "left").select("document_id", zero("n_pages"), zero("n_chunks"), zero("n_tokens"))
