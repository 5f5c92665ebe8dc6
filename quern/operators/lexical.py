"""BM25 over an inverted index, as joins and aggregations.

Statistics are those of the whole corpus, whatever a search is scoped to. A search keeps only postings of the
questions' tokens: they are joined before anything is grouped, so the shuffle carries matches, not the corpus.

Whole texts are dealt by document, some ``WORDS`` words to a task, and cut into tokens there: a row for each token of what
a task happens to read would be several times its text, all held until it is shuffled. Postings, a row for each document
and token, are dealt on. A common word makes a pair of each question and document. Pairs are never shuffled: postings are
dealt to so many tasks that one has at most about ``PAIRS`` of them, however large the corpus, and only its best leave it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, lexical_tokens

#: Question tokens up to so many rows (some 30 MB) are broadcast; beyond it the join shuffles both sides.
BROADCAST_TOKENS = 500_000
#: Pairs of questions and documents that a task may have to score (some 350 bytes each), and its documents at most.
PAIRS, DOCUMENTS = 500_000, 10_000
#: Words of texts that a task cuts into tokens, about.
WORDS = 1_000_000


def tokenized(docs: DataFrame) -> DataFrame:
    """(id, ts, dl) of (id, text)."""
    return docs.select("id", lexical_tokens(F.col("text")).alias("ts")).withColumn("dl", F.size("ts"))


def term_frequency(docs: DataFrame) -> DataFrame:
    return tokenized(docs).select("id", F.explode("ts").alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))


def index_stats(docs: DataFrame) -> DataFrame:
    """One row (n_docs, avgdl); documents without tokens count."""
    n, dl = F.count("*"), F.sum(F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(TOKEN)))
    return docs.select("text").agg(n.alias("n_docs"), F.when(n == 0, F.lit(0.0)).otherwise(dl / n).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def document_frequency(docs: DataFrame) -> DataFrame:
    """(token, df, idf)."""
    n = index_stats(docs).select("n_docs").scalar()
    once = tokenized(docs).select(F.explode(F.array_distinct("ts")).alias("token"))
    return once.groupBy("token").agg(F.count("*").alias("df")).withColumn("idf", idf(n, F.col("df")))


def question_tokens(questions: DataFrame) -> DataFrame:
    """(query_id, token, qtf, pos): tokens with their number and first place; repeats count repeatedly."""
    rows = questions.select("query_id", F.posexplode(lexical_tokens(F.col("text"))).alias("pos", "token"))
    return rows.groupBy("query_id", "token").agg(F.count("*").alias("qtf"), F.min("pos").alias("pos"))


def tasks_for(df: DataFrame, n_docs: int, n_questions: int) -> int:
    """To how many tasks documents are dealt that are scored for so many questions."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n_docs * n_questions / PAIRS), math.ceil(n_docs / DOCUMENTS))


def cutting_tasks(df: DataFrame, n_words: float) -> int:
    """To how many tasks texts of so many words are dealt that are cut into tokens."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n_words / WORDS))


def bm25_scores(docs: DataFrame, questions: DataFrame, k1: float = 0.9, b: float = 0.4, owners: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, pos) of every document with a token of the question; pos is the first that matches.

    With ``owners`` (id, owner), questions have an owner, too: documents of others are left out of what is scored, and a
    document comes once for each row of it there that fits."""
    asked = question_tokens(questions)
    vocabulary = asked.select("token").distinct()
    told = asked.agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("queries")).first()
    small = told.n <= BROADCAST_TOKENS
    near = F.broadcast if small else lambda df: df
    size = index_stats(docs).first()
    cuts, tasks = cutting_tasks(docs, size.n_docs * size.avgdl), tasks_for(docs, size.n_docs, told.queries)
    if tasks == cuts:
        tasks += 1  # postings dealt like the texts would not be shuffled, and so made again by each that reads them
    held = tokenized(docs.select("id", "text").repartition(cuts, "id")).select("id", "dl", F.explode("ts").alias("token")).join(near(vocabulary), "token")
    if not small:
        held = held.repartition(cuts, "id")
    # dealt by document: scores of a document then need no further shuffle
    postings = held.groupBy("id", "token", "dl").agg(F.count("*").alias("tf")).repartition(tasks, "id")
    # the condition always holds; as it reads whole postings, those that were shuffled for the scores serve here, too
    df = F.count_if(F.col("tf") <= F.col("dl")).alias("df")
    terms = postings.groupBy("token").agg(df).select("token", idf(F.lit(size.n_docs).cast("bigint"), F.col("df")).alias("idf"), F.lit(size.avgdl).alias("avgdl")).join(near(asked), "token")
    weight = F.col("qtf") * F.col("idf") * F.col("tf") * F.lit(k1 + 1) / (F.col("tf") + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * F.col("dl") / F.col("avgdl")))
    summed = F.round(F.sum(weight), 9).alias("score"), F.min("pos").alias("pos")
    if owners is None:
        return postings.join(near(terms), "token").groupBy("query_id", "id").agg(*summed)
    wanted = questions.groupBy("query_id", F.col("owner").cast("string").alias("_scope")).agg(F.count("*").alias("_asked"))
    own = owners.select("id", F.col("owner").cast("string").alias("_owner")).repartition(tasks, "id").groupBy("id", "_owner").agg(F.count("*").alias("_rows"))
    joined = postings.join(own, "id", "left").join(near(terms.join(near(wanted), "query_id")), "token")
    fitting = joined.where(F.col("_scope").isNull() | (F.col("_scope") == F.col("_owner")))
    times = F.max(F.col("_asked") * F.coalesce("_rows", F.lit(1))).cast("int").alias("_times")
    found = fitting.groupBy("query_id", "id", "_scope", "_owner").agg(*summed, times)
    return found.select("query_id", "id", "score", "pos", F.explode(F.array_repeat(F.lit(0), F.col("_times"))).alias("_row")).drop("_row")


def ranked(scores: DataFrame, top_k: int | None = None) -> DataFrame:
    """(query_id, id, score, rank): by score, then the first matching token, then id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos", "id")
    out = scores.withColumn("rank", F.row_number().over(order)).select("query_id", "id", "score", "rank")
    return out if top_k is None else out.where(F.col("rank") <= top_k)


def bm25(docs: DataFrame, questions: DataFrame, top_k: int = 10, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    return ranked(bm25_scores(docs, questions, k1, b), top_k)


def bm25_scoped(docs: DataFrame, questions: DataFrame, owners: DataFrame, top_k: int = 10, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """``questions`` have an owner; documents of others are dropped before the cut, and none where it is
    null. owners: (id, owner)."""
    return ranked(bm25_scores(docs, questions, k1, b, owners), top_k)
