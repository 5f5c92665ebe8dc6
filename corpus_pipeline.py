"""A corpus from raw documents to token ids: five stages, each over all that the one before kept.

toxicity: documents that the model, fitted to the labels of the documents it sees, scores 0.5 or more go.
near_duplicates: one document of each group of near copies (5-word shingles, likeness 0.8) stays, the smallest doc_id.
decontamination: documents that hold a test item of the benchmark go.
personal_data: all documents stay, with personal data in their texts replaced by its kind.
byte_bpe: token ids by byte-level BPE, and the digest of the bytes that they decode to.

Rows with null doc_id are never near copies of others. Rows of one doc_id are compared like those of several: of those
that are near copies of each other, or have no words, the first by text stays. Columns of documents may have any names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm import bpe, decontaminate, minhash, pii, toxicity
from quern.llm.common import dropped, free_name, leaving, prepare, scratch, shared_dir, table


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model, score = toxicity.trained(docs.select("doc_id", "text"), labels), free_name(docs.columns, "_score")
    return toxicity.scored(docs, model, score).where(F.col(score) < 0.5).select(*docs.columns)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    n, own_set, component = (free_name(docs.columns, c) for c in ("_n", "_set", "_component"))
    rows = minhash.clusters(docs.select("doc_id", "text"), n=5, percent=80, by_row=True).where("doc_id is not null")
    kept = rows.groupBy("doc_id").agg(F.count("*").alias(n), F.max("kept").alias("kept")).where("kept").select("doc_id", n)
    chosen = docs.join(kept, "doc_id")
    once = chosen.where(F.col(n) == 1).select(*docs.columns)
    staying = rows.where("kept").select("doc_id", F.col("set_id").alias(own_set), F.col("component").alias(component)).distinct()
    order = Window.partitionBy("doc_id", component).orderBy("text")
    several = minhash.set_ids(chosen.where(F.col(n) > 1), 5, own_set).join(staying, ["doc_id", own_set])
    several = several.withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).select(*docs.columns)
    return once.unionByName(several).unionByName(docs.where("doc_id is null"))


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    hits = free_name(docs.columns, "_hits")
    found = decontaminate.contaminated(docs, decontaminate.benchmark_items(spark, sf_dir), hits)
    return found.where(F.size(hits) == 0).select(*docs.columns)


def personal_data_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pii.redacted(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return bpe.encode_checked(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_duplicates_out),
    ("decontamination", contaminated_out),
    ("personal_data", personal_data_redacted),
    ("byte_bpe", encoded),
]
#: SQL can express none of the model, the sketches and the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of the documents that stay. Tables between the stages go once they are read;
    the one that the last stage reads goes with the application."""
    docs, held = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/quern-stage-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        if held is not None:
            dropped(held)
        docs = held = spark.read.schema(made.schema).parquet(path)
    leaving(spark, path)
    return STAGES[-1][1](spark, docs, sf_dir)
