import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import whitening as W

KINDS = "vec_id bigint, embedding array<float>, label int"


def stored(spark, tmp_path, rows):
    spark.createDataFrame(rows, KINDS).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def brute(vectors):
    x = np.floor(1024 * np.array(vectors, np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    c = x - s / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return n, ((n * x - s) ** 2).sum(axis=1), values[::-1], c @ vectors[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-300))


def check(rows, vectors, ids, k=8):
    n, deviation, values, whole = brute(vectors)
    by = {(r.vec_id, r.component): r for r in rows}
    assert len(rows) == len(by) == len(ids) * k
    for c in range(k):
        own = np.array([by[i, c + 1].whitened for i in ids])
        assert min(np.abs(own - whole[:, c]).max(), np.abs(own + whole[:, c]).max()) < 1e-9
        assert all(abs(by[i, c + 1].explained - values[c] / values.sum()) < 1e-12 for i in ids)
    assert [by[i, 1].deviation for i in ids] == deviation.tolist()
    assert {r.n for r in rows} == {n} and all(r.identity_error < 1e-10 and r.residual < 1e-11 for r in rows)
    assert all(int(r.deviation_exact) == r.deviation for r in rows)


def test_components_equal_a_dense_solution(spark, tmp_path):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((700, 40)) * np.linspace(1, 0.2, 40)).astype(np.float32)
    rows = [(i, v.tolist(), None) for i, v in enumerate(vectors)]
    rows += [(1000, None, 1), (1001, [None, *vectors[0, 1:].tolist()], 1), (1002, [float("nan")] * 40, 1), (1003, [float("inf")] * 40, 1), (1004, [-float("inf"), *vectors[0, 1:].tolist()], 1)]
    check(W.op11_whitening(spark, stored(spark, tmp_path, rows)).collect(), vectors, range(700))


def test_the_block_is_smaller_than_the_space(spark):
    """Iterations with residuals and directions, not one dense problem."""
    rng = np.random.default_rng(2)
    vectors = rng.standard_normal((400, 90)) * np.linspace(2, 0.1, 90)
    rows = spark.createDataFrame([(v.tolist(),) for v in vectors], "vector array<double>")
    model = W.fitted(rows, k=3)
    assert 3 * (3 + W.GUARD) < 90 and model.found.passes > 3 and model.found.residual < 1e-11
    values = brute(vectors)[2]
    assert np.abs(model.found.values / values[:3] - 1).max() < 1e-12 and model.found.vectors.shape == (90, 3)


def test_few_dimensions_repeated_rows_and_null_ids(spark, tmp_path):
    vectors = [[1.0, 2.0, 0.5], [0.5, -1.0, 0.25], [0.1, 0.9, -3.0], [2.0, 0.0, 1.0], [1.0, 2.0, 0.5]]
    rows = [(None, vectors[0], 1), (7, vectors[1], 1), (8, vectors[2], 1), (9, vectors[3], 1), (7, vectors[4], 1)]
    got = W.op11_whitening(spark, stored(spark, tmp_path, rows)).collect()
    n, deviation, values, whole = brute(np.array(vectors, np.float32))
    assert len(got) == 15 and {r.component for r in got} == {1, 2, 3} and {r.n for r in got} == {5}
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation.tolist())
    for c in range(3):
        own = sorted(abs(r.whitened) for r in got if r.component == c + 1)
        assert np.abs(np.array(own) - np.sort(np.abs(whole[:, c]))).max() < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 1.0], 0)], [(1, [0.5], 0), (2, [0.5], 0)], [(1, [], 0)], [(1, None, 0)]])
def test_nothing_that_varies(spark, tmp_path, rows):
    out = W.op11_whitening(spark, stored(spark, tmp_path, rows))
    assert out.collect() == [] and out.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_components_without_variance_go(spark):
    vectors = [[float(k), 2.0 * k, 1.0] for k in range(30)]
    model = W.fitted(spark.createDataFrame([(v,) for v in vectors], "vector array<double>"))
    assert len(model.found.values) == 1 and abs(model.found.values[0] / model.found.trace - 1) < 1e-9


def test_large_numbers_are_exact_or_null(spark, tmp_path):
    rows = [(k, [1e9 * k, 3.0], 0) for k in range(1, 60)]
    got = {r.vec_id: r for r in W.op11_whitening(spark, stored(spark, tmp_path, rows)).where("component = 1").collect()}
    x = [[int(np.floor(1024 * float(np.float32(1e9 * k)))) + 100_000, 103_072] for k in range(1, 60)]
    sums = [sum(c) for c in zip(*x, strict=True)]
    for k in range(1, 60):
        want = sum((59 * a - s) ** 2 for a, s in zip(x[k - 1], sums, strict=True))
        assert int(got[k].deviation_exact) == want and got[k].deviation == (want if want < 1 << 63 else None)


def test_unlike_sizes_are_an_error(spark):
    rows = spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "vector array<double>").repartition(2)
    with pytest.raises(Exception, match="one size"):
        W.fitted(rows)


def test_other_columns_stay(spark):
    rows = spark.createDataFrame([(k, [float(k), float(k * k % 7)], "x") for k in range(20)], "k int, vector array<double>, n string").withColumn("size", F.lit(1))
    out = W.whitened(rows, W.fitted(rows, k=1))
    assert out.columns == ["k", "vector", "n", "size", "whitened", "deviation_exact"] and out.count() == 20
