"""Reciprocal-rank fusion of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import sound


def fuse(rankings: list[DataFrame], k: int = 10, top_k: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, id, score, rank) of rankings (query_id, id, rank): the sum of 1 / (k + rank) over lists.

    Ties go to the item that the earliest list has, then to its rank there. Ids repeated in a list add up. Columns to
    ``carry`` come from the lists that have them, else they are null.
    """
    sound(rankings[0].sparkSession)
    brought = lambda r: [(F.col(c) if c in r.columns else F.lit(None)).cast("double").alias(c) for c in carry]
    named = [r.select("query_id", "id", F.col("rank").cast("int").alias("rank"), F.lit(n).alias("list_no"), *brought(r)) for n, r in enumerate(rankings)]
    rows = named[0]
    for r in named[1:]:
        rows = rows.unionByName(r)
    score = F.round(F.sum(1 / (F.lit(float(k)) + F.col("rank"))), 12)
    fused = rows.groupBy("query_id", "id").agg(score.alias("score"), F.min(F.struct("list_no", "rank")).alias("first"), *(F.max(c).alias(c) for c in carry))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first.list_no", "first.rank", "id")
    out = fused.withColumn("rank", F.row_number().over(order)).select("query_id", "id", *carry, "score", "rank")
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def fuse_for(rankings: list[DataFrame], ks: list[int], top_k: int) -> DataFrame:
    """``fuse`` for each constant at once: (k, query_id, id, score, rank)."""
    sound(rankings[0].sparkSession)
    named = [r.select("query_id", "id", F.col("rank").cast("int").alias("rank"), F.lit(n).alias("list_no")) for n, r in enumerate(rankings)]
    rows = named[0]
    for r in named[1:]:
        rows = rows.unionByName(r)
    rows = rows.withColumn("k", F.explode(F.array(*map(F.lit, ks))))
    score = F.round(F.sum(1 / (F.col("k").cast("double") + F.col("rank"))), 12)
    fused = rows.groupBy("k", "query_id", "id").agg(score.alias("score"), F.min(F.struct("list_no", "rank")).alias("first"))
    order = Window.partitionBy("k", "query_id").orderBy(F.desc("score"), "first.list_no", "first.rank", "id")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k).select("k", "query_id", "id", "score", "rank")
