"""The files of a retrieval benchmark: corpus and queries as JSON lines, judgements as a table with tabs.

Where a line repeats a key, the last one counts, and a limit takes the first; ``LINE`` tells their order in the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stripped

RECORD = "_id string, title string, text string"


def line_order() -> Column:
    """The place of a row in the files it is read from: file, start of the part that a task reads, and row in that."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))


def corpus_rows(records: DataFrame) -> DataFrame:
    """(id, text[, line]) of (_id, title, text[, line]): title and body on lines of their own, without records that have neither."""
    clean = lambda c: stripped(F.coalesce(F.col(c), F.lit("")))
    title, body = clean("title"), clean("text")
    text = F.when(title != "", F.concat(title, F.lit("\n"), body)).otherwise(body)
    line = [c for c in records.columns if c == "line"]
    return records.select(F.col("_id").alias("id"), stripped(text).alias("text"), *line).where(F.length("text") > 0)


def first_rows(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first rows by ``line``, which goes; 0 and None are no limit."""
    return (rows.orderBy("line").limit(limit) if limit else rows).drop("line")


def corpus_scan(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The corpus; a limit counts kept records in the order of the file."""
    return first_rows(corpus_rows(spark.read.schema(RECORD).json(path).withColumn("line", line_order())), limit)


def qrels_rows(records: DataFrame) -> DataFrame:
    """(query_id, id, grade) with grades above zero; of repeated pairs the last by ``line`` stays, or without such a column
    the greatest."""
    last = F.max_by("grade", "line") if "line" in records.columns else F.max("grade")
    return records.where("grade > 0").groupBy("query_id", "id").agg(last.alias("grade"))


def qrels_scan(spark: SparkSession, path: str) -> DataFrame:
    """Judgements; a line after the first that has not three fields, the last a whole number, is an error."""
    raw = spark.read.csv(path, sep="\t", header=True, enforceSchema=True, schema="query_id string, id string, grade string, more string")
    grade = F.expr("try_cast(grade as int)")
    sound = F.col("id").isNotNull() & grade.isNotNull() & F.col("more").isNull()
    told = F.when(sound, grade).otherwise(F.raise_error(F.concat(F.lit("not a judgement: "), F.concat_ws("\t", "query_id", "id", "grade", "more"))).cast("int"))
    return qrels_rows(raw.withColumn("line", line_order()).select("query_id", "id", told.alias("grade"), "line"))


def judged_queries(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries (query_id, text[, line]) that have judgements; with ``line``, the last of each id."""
    rows = queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi")
    if "line" in queries.columns:
        rows = rows.groupBy("query_id").agg(F.max_by("text", "line").alias("text"))
    return rows


def queries_scan(spark: SparkSession, path: str, qrels: DataFrame) -> DataFrame:
    rows = spark.read.schema("_id string, text string").json(path).withColumn("line", line_order()).where("_id is not null")
    return judged_queries(rows.select(F.col("_id").alias("query_id"), "text", "line"), qrels)


def first_queries(queries: DataFrame, limit: int | None) -> DataFrame:
    """The first queries by id as text; 0 and None are no limit."""
    rows = queries.orderBy(F.col("query_id").cast("string"))
    return rows.limit(limit) if limit else rows
