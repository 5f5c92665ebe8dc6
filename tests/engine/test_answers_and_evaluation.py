import math
import random

import pytest
from pyspark.sql import functions as F

from quern.errors import GenerationError
from quern.operators import answer, evaluate


def test_contexts(spark):
    rows = [(1, 2, "d2", 7, "second"), (1, 1, "d1", 3, "first\nline"), (2, 1, "d9", 1, "x")]
    got = {r.query_id: (r.n_sources, r.context) for r in answer.contexts(spark.createDataFrame(rows, "query_id long, rank int, document_id string, page_number int, text string")).collect()}
    assert got == {1: (2, "[S1] Document: d1; Page: 3\nfirst\nline\n\n[S2] Document: d2; Page: 7\nsecond"), 2: (1, "[S1] Document: d9; Page: 1\nx")}


def test_citations(spark):
    said = "x [S2] y [S1][S2] [S9] [S1, S2] [S01] z"
    df = spark.createDataFrame([(1, said, 2), (2, said, 0), (3, "none", 4), (4, None, 1)], "query_id long, answer string, n int")
    cited = df.select("query_id", answer.cited(F.col("answer"), F.col("n")).alias("cited"))
    assert {r.query_id: r.cited for r in cited.collect()} == {1: ["S2", "S1"], 2: [], 3: [], 4: None}
    sources = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "query_id long, rank int, id string")
    assert sorted(map(tuple, answer.citations(cited, sources).collect())) == [(1, 0, "S2", "b"), (1, 1, "S1", "a")]


def test_refusals_and_chat(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, text string")
    got = answer.refusals(asked, spark.createDataFrame([(1, "s")], "query_id long, id string")).collect()
    assert [tuple(r) for r in got] == [(2, answer.REFUSAL)]
    prompts = asked.withColumnRenamed("text", "prompt")
    assert {r.answer for r in answer.answered(prompts, lambda: lambda p: f" {p}! ").collect()} == {"a!", "b!"}
    with pytest.raises(Exception, match=GenerationError.__name__):
        answer.answered(prompts, lambda: lambda p: "  ").collect()


def plain(run, qrels):
    """{query: (ndcg10, recall10, recall100, mrr10)} from {query: ids in order} and {query: {id: grade}}."""
    out = {}
    for q, grades in qrels.items():
        ids = run.get(q, [])
        dcg = sum((2 ** grades.get(d, 0) - 1) / math.log2(k + 2) for k, d in enumerate(ids[:10]))
        best = sum((2**g - 1) / math.log2(k + 2) for k, g in enumerate(sorted(grades.values(), reverse=True)[:10]))
        hit = lambda n, ids=ids, grades=grades: sum(d in grades for d in ids[:n]) / len(grades)
        first = next((1 / k for k, d in enumerate(ids[:10], 1) if d in grades), 0.0)
        out[q] = (dcg / best if best else 0.0, hit(10), hit(100), first)
    return out


def test_metrics(spark):
    rng = random.Random(2)
    run = {q: rng.sample(range(150), rng.choice([0, 3, 12, 120])) for q in range(20)}
    qrels = {q: {d: rng.randint(1, 3) for d in rng.sample(range(150), rng.choice([1, 2, 15]))} for q in range(2, 25)}
    qrels[30], run[30] = {7: 1}, [*range(100, 110), 7]  # the only relevant one comes eleventh
    runs = spark.createDataFrame([(q, d, k) for q, ids in run.items() for k, d in enumerate(ids, 1)], "query_id long, id long, rank int")
    judged = spark.createDataFrame([(q, d, g) for q, by in qrels.items() for d, g in by.items()], "query_id long, id long, grade int")
    metrics = evaluate.per_query(runs, judged)
    got = {r.query_id: (r.ndcg10, r.recall10, r.recall100, r.mrr10) for r in metrics.collect()}
    want = plain(run, qrels)
    assert set(got) == set(want) and all(got[q] == pytest.approx(want[q]) for q in want)
    assert want[30][3] == 0.0
    total = evaluate.summary(metrics).first()
    assert total.n_queries == len(want) and total.ndcg10 == pytest.approx(sum(x[0] for x in want.values()) / len(want), abs=1e-6)
    ks = spark.createDataFrame([(1,), (2,)], "k int")
    both = runs.withColumn("k", F.lit(1)).unionByName(runs.where("query_id = -1").withColumn("k", F.lit(2)))
    by = {r.k: r.mrr10 for r in evaluate.summary(evaluate.per_query(both, judged, ("k",), ks), ("k",)).collect()}
    assert by[2] == 0.0 and by[1] == pytest.approx(total.mrr10)


def test_threshold_sweep(spark):
    hits = spark.createDataFrame([(1, 10, 0.2, 1), (1, 11, 0.5, 2), (1, 12, 0.9, 3), (2, 20, 0.8, 1)], "query_id long, id long, distance double, rank int")
    qrels = spark.createDataFrame([(1, 11, 1), (1, 99, 1), (2, 20, 2), (3, 5, 1)], "query_id long, id long, grade int")
    got = {r.cutoff: tuple(r)[1:] for r in evaluate.threshold_sweep(hits, qrels, [0.1, 0.5, 0.8]).collect()}
    assert got[0.1] == (0.0, 0.0, 0.0, 1.0)
    assert got[0.5] == pytest.approx((2 / 3, 0.5 / 3, 0.5 / 3, 2 / 3), abs=1e-6)
    assert got[0.8] == pytest.approx((1.0, 1.5 / 3, 1.5 / 3, 1 / 3), abs=1e-6)
