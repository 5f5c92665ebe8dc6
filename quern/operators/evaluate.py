"""Retrieval quality against graded judgements. Runs are (query_id, id, rank), qrels (query_id, id, grade > 0)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import sound

#: What the sweeps try.
RRF_CONSTANTS = [5, 10, 20, 40, 60, 100]
CUTOFFS = [0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65]


def runs(dense: DataFrame, lexical: DataFrame, k: int = 10, top_k: int = 100, score: Column | None = None, texts: DataFrame | None = None, questions: DataFrame | None = None, depth: int = 50) -> DataFrame:
    """(mode, query_id, id, rank) of every way to search at once: bm25, dense, hybrid (their fusion) and, with ``score``,
    dense_rerank (the first ``depth`` neighbours ordered anew by it, over columns question and text).

    Both lists, at most ``top_k`` long, are read once: an item has its rank in either, and from those its rank in each mode.
    """
    sound(dense.sparkSession)
    tagged = lambda df, own, other: df.select("query_id", "id", F.col("rank").cast("int").alias(own), F.lit(None).cast("int").alias(other))
    rows = tagged(dense, "dense", "lexical").unionByName(tagged(lexical, "lexical", "dense"))
    part = F.sum(F.coalesce(1 / (F.lit(float(k)) + F.col("dense")), 1 / (F.lit(float(k)) + F.col("lexical"))))
    found = rows.groupBy("query_id", "id").agg(F.min("dense").alias("dense"), F.min("lexical").alias("bm25"), F.round(part, 12).alias("score"))
    own = Window.partitionBy("query_id")
    found = found.withColumn("hybrid", F.row_number().over(own.orderBy(F.desc("score"), F.col("dense").isNull(), F.coalesce("dense", "bm25"), "id")))
    modes = ["bm25", "dense", "hybrid"]
    if score is not None:
        paired = found.join(texts.select("id", "text"), "id").join(questions.select("query_id", F.col("text").alias("question")), "query_id")
        head = F.when(F.col("dense") <= depth, score)
        order = own.orderBy(F.col("dense").isNull(), F.col("dense") > depth, F.desc("again"), "dense")
        found = paired.withColumn("again", head).withColumn("dense_rerank", F.when(F.col("dense").isNotNull(), F.row_number().over(order)))
        modes.append("dense_rerank")
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.col(m).alias("rank")) for m in modes))).alias("x")
    return found.select("query_id", "id", each).select("x.mode", "query_id", "id", "x.rank").where(F.col("rank") <= top_k)


def per_query(run: DataFrame, qrels: DataFrame, by: tuple[str, ...] = (), params: DataFrame | None = None) -> DataFrame:
    """(by..., query_id, ndcg10, recall10, recall100, mrr10) of every judged query; one without results has zeros.

    ``by`` names parameters that the run is repeated for, ``params`` their values.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("grade"))
    judged = qrels.withColumn("ideal_rank", F.row_number().over(order))
    gain = lambda rank: (F.pow(F.lit(2.0), F.col("grade")) - 1) / F.log2(F.col(rank) + 1.0)
    ideal = judged.groupBy("query_id").agg(F.sum(F.when(F.col("ideal_rank") <= 10, gain("ideal_rank")).otherwise(0.0)).alias("ideal"), F.count("*").alias("relevant"))
    hits = run.join(qrels, ["query_id", "id"]).groupBy(*by, "query_id").agg(
        F.sum(F.when(F.col("rank") <= 10, gain("rank")).otherwise(0.0)).alias("dcg"),
        F.sum((F.col("rank") <= 10).cast("int")).alias("hits10"),
        F.sum((F.col("rank") <= 100).cast("int")).alias("hits100"),
        F.min("rank").alias("first"),
    )
    if params is not None:
        ideal = ideal.withColumn("_", F.lit(1)).join(F.broadcast(params.withColumn("_", F.lit(1))), "_").drop("_")
    rows = ideal.join(hits, [*by, "query_id"], "left")
    of = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select(
        *by,
        "query_id",
        F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg10"),
        (of("hits10") / F.col("relevant")).alias("recall10"),
        (of("hits100") / F.col("relevant")).alias("recall100"),
        F.when(F.col("first") <= 10, 1.0 / F.col("first")).otherwise(0.0).alias("mrr10"),
    )


def summary(metrics: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Means over queries."""
    means = [F.round(F.avg(c), 6).alias(c) for c in ("ndcg10", "recall10", "recall100", "mrr10")]
    return metrics.groupBy(*by).agg(F.count("*").alias("n_queries"), *means)


def threshold_sweep(hits: DataFrame, qrels: DataFrame, cutoffs: list[float]) -> DataFrame:
    """(cutoff, mean_kept, precision, recall100, empty_share) of hits (query_id, id, distance, rank).

    Precision is 0 for a query that keeps nothing; means are over judged queries.
    """
    cutoffs = sorted(cutoffs)
    judged = qrels.groupBy("query_id").agg(F.count("*").alias("relevant"))
    marked = hits.where("distance is not null").join(qrels.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    # a histogram for each query: a hit falls to the first cutoff that keeps it, and all later ones keep it, too
    hit = F.coalesce("hit", F.lit(0))
    counts = (F.count("*").alias("kept"), F.sum(hit).alias("hits"), F.sum(F.when(F.col("rank") <= 100, hit).otherwise(0)).alias("hits100"))
    first = F.size(F.filter(F.array(*map(F.lit, cutoffs)), lambda c: c < F.col("distance")))
    bins = marked.withColumn("at", first).where(F.col("at") < len(cutoffs)).groupBy("query_id", "at").agg(*counts)
    whole = bins.groupBy("query_id").agg(F.collect_list(F.struct("at", "kept", "hits", "hits100")).alias("bins"))
    grid = judged.join(whole, "query_id", "left").select("query_id", "relevant", "bins", F.posexplode(F.array(*map(F.lit, cutoffs))).alias("place", "cutoff"))
    total = lambda c: F.aggregate(F.coalesce("bins", F.array().cast(whole.schema["bins"].dataType)), F.lit(0).cast("bigint"), lambda s, x: s + F.when(x["at"] <= F.col("place"), x[c]).otherwise(0))
    one = grid.select("cutoff", "relevant", *(total(c).alias(c) for c in ("kept", "hits", "hits100")))
    return one.groupBy("cutoff").agg(
        F.round(F.avg("kept"), 6).alias("mean_kept"),
        F.round(F.avg(F.when(F.col("kept") > 0, F.col("hits") / F.col("kept")).otherwise(0.0)), 6).alias("precision"),
        F.round(F.avg(F.col("hits100") / F.col("relevant")), 6).alias("recall100"),
        F.round(F.avg((F.col("kept") == 0).cast("double")), 6).alias("empty_share"),
    )
