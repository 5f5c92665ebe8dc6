"""Second-stage ordering by a scorer of (question, text) pairs that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import RerankError
from ..functions.text import lexical_tokens


def scorer(load: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 32):
    """A column function score(question, text); the model is loaded once a task, and only if it has pairs."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = None
        for questions, texts in batches:
            pairs, out = list(zip(questions, texts, strict=True)), []
            if pairs and model is None:
                model = load()
            for k in range(0, len(pairs), batch):
                got = list(model(pairs[k : k + batch]))
                if len(got) != len(pairs[k : k + batch]):
                    raise RerankError("the scorer must answer with one score for each pair")
                out += map(float, got)
            yield pd.Series(out, dtype="float64")

    return score


def overlap_score(question: Column, text: Column) -> Column:
    """A scorer without a model: how many distinct tokens of the question the text has."""
    return F.size(F.array_intersect(lexical_tokens(question), lexical_tokens(text))).cast("double")


def rerank(candidates: DataFrame, score: Column, top_k: int | None = None) -> DataFrame:
    """Candidates (query_id, id, rank, ...) by score, ties by their rank: adds ``rerank_score``, renews ``rank``."""
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    out = candidates.withColumn("rerank_score", score).withColumn("rank", F.row_number().over(order))
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def rerank_head(candidates: DataFrame, score: Column, depth: int) -> DataFrame:
    """Only the first ``depth`` change places; the rest keeps its order behind them."""
    head = F.col("rank") <= depth
    scored = candidates.withColumn("rerank_score", F.when(head, score))
    order = Window.partitionBy("query_id").orderBy((F.col("rank") > depth).asc(), F.desc("rerank_score"), "rank")
    return scored.withColumn("rank", F.row_number().over(order))
