"""Evidence for an answer, and what the answer cites of it."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import GenerationError

#: Fixed value: what a question without evidence gets.
REFUSAL = "I don't have enough information in the uploaded documents."
CITATION = r"\[(S[0-9]+)\]"


def contexts(sources: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, n_sources, context[, sources]) of ranked sources (query_id, rank, document_id, page_number, text).

    With columns to ``carry``, ``sources`` has them for each source by rank.
    """
    block = F.concat(F.lit("[S"), F.col("rank").cast("string"), F.lit("] Document: "), F.col("document_id").cast("string"), F.lit("; Page: "), F.col("page_number").cast("string"), F.lit("\n"), F.col("text"))
    blocks = F.array_sort(F.collect_list(F.struct("rank", block.alias("block"), *carry)))
    held = [F.transform(blocks, lambda x: F.struct(*(x[c].alias(c) for c in carry))).alias("sources")] if carry else []
    return sources.groupBy("query_id").agg(F.count("*").alias("n_sources"), F.array_join(F.transform(blocks, lambda x: x["block"]), "\n\n").alias("context"), *held)


def cited(answer: Column, n_sources: Column) -> Column:
    """The labels that an answer cites, by first mention, without those that no source has."""
    labels = F.transform(F.sequence(F.lit(1), F.greatest(n_sources, F.lit(1))), lambda i: F.concat(F.lit("S"), i.cast("string")))
    found = F.array_distinct(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)))
    return F.when(n_sources > 0, F.array_intersect(found, labels)).otherwise(F.expr("cast(array() as array<string>)"))


def citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, position, source_id, id) of answers (query_id, cited) and sources (query_id, rank, id)."""
    named = sources.select("query_id", "id", F.concat(F.lit("S"), F.col("rank").cast("string")).alias("source_id"))
    rows = answers.select("query_id", F.posexplode("cited").alias("position", "source_id"))
    return rows.join(named, ["query_id", "source_id"]).select("query_id", "position", "source_id", "id")


def refusals(questions: DataFrame, sources: DataFrame) -> DataFrame:
    """(query_id, answer) of questions without any source."""
    return questions.join(sources.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit(REFUSAL).alias("answer"))


def _checked(texts: Iterable[str | None]) -> list[str]:
    out = [(t or "").strip() for t in texts]
    if not all(out):
        raise GenerationError("the model gave no answer")
    return out


def chat(load: Callable[[], Callable[[str], str]]) -> Callable[[Column], Column]:
    """A column function answer(prompt) by a chat model that the caller brings, loaded once a task and only if there are
    prompts; blank answers are an error. Spark calls it once for each row, as another call may answer otherwise."""

    @F.pandas_udf("string")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for prompts in batches:
            if len(prompts) and model is None:
                model = load()
            yield pd.Series(_checked(map(model, prompts)) if len(prompts) else [], dtype="object")

    return answer.asNondeterministic()


def answered(prompts: DataFrame, load: Callable[[], Callable[[str], str]]) -> DataFrame:
    """(query_id, answer) of (query_id, prompt)."""
    return prompts.select("query_id", chat(load)(F.col("prompt")).alias("answer"))
