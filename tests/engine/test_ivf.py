import numpy as np
import pytest

from quern.errors import VectorStoreError
from quern.operators import ivf, vector
from quern.operators.ivf import IvfIndex


def frame(spark, m, n, kinds="id string, vector array<float>, owner string"):
    return spark.createDataFrame([(f"c{i:05d}" if "id string" in kinds else i, v.tolist(), f"o{i % 3}") for i, v in enumerate(m[:n])], kinds)


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(4)
    return (rng.standard_normal((40, 16))[rng.integers(0, 40, 3000)] + 0.3 * rng.standard_normal((3000, 16))).astype(np.float32)


def test_recall_and_exact_distances(spark, tmp_path, clustered):
    index = IvfIndex(spark, str(tmp_path / "i"))
    with pytest.raises(VectorStoreError):
        index.state()
    rows = frame(spark, clustered, 3000)
    index.build(rows)
    queries = rows.where("substr(id, -1) = '7'").selectExpr("id as query_id", "vector")
    exact = {(r.query_id, r.id): r.distance for r in vector.nearest(rows, queries, 10).collect()}
    found = index.search(queries, 10).collect()
    state = index.state()
    assert 1 <= state["probes"] < state["lists"] / 4 and len(found) == 10 * queries.count()
    both = [(r.distance, exact[r.query_id, r.id]) for r in found if (r.query_id, r.id) in exact]
    assert len(both) >= 0.95 * len(exact) and all(abs(a - b) < 2e-9 for a, b in both)
    assert ivf.recall(index.search(queries, 10, probes=state["lists"]), vector.nearest(rows, queries, 10)) >= 0.99
    one = index.search(queries, 10, probes=1)
    assert "BroadcastNestedLoop" not in one._jdf.queryExecution().executedPlan().toString()
    # scoped: the third of the queries' own owner
    own = queries.selectExpr("query_id", "vector", "case when query_id like '%17' then null else 'o1' end as scope")
    got = {(r.query_id, r.id) for r in index.search(own, 5, probes=state["lists"]).collect()}
    want = {(r.query_id, r.id) for r in vector.nearest(rows, own, 5, scoped=True).collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got) == len(want)


def test_hot_lists_odd_vectors_and_empty_tables(spark, tmp_path):
    same = [(i, [1.0, 2.0, 3.0], "o") for i in range(700)]
    odd = [(800, None, "o"), (801, [0.0, 0.0, 0.0], "o"), (802, [float("nan"), 1.0, 1.0], "o"), (803, [-1.0, 0.5, 0.0], "o"), (None, [1.0, 0.0, 0.0], "o")]
    rows = spark.createDataFrame([*same, *odd], "id long, vector array<double>, owner string")
    index = IvfIndex(spark, str(tmp_path / "i"))
    index.build(rows, lists=3)
    queries = spark.createDataFrame([(1, [2.0, 4.0, 6.0]), (2, None), (3, [0.0, 0.0, 0.0])], "query_id long, vector array<double>")
    got = index.search(queries, 5, probes=3).collect()
    assert {r.query_id for r in got} == {1} and len(got) == 5 and all(r.distance == 0 and r.id < 700 for r in got)
    index.build(rows.limit(0))
    assert index.search(queries).collect() == [] and index.search(queries).columns == ["query_id", "id", "distance", "rank"]
    with pytest.raises(Exception, match="one size"):
        index.build(spark.createDataFrame([(1, [1.0], "o"), (2, [1.0, 2.0], "o")], rows.schema))
