import pytest

from quern.errors import VectorStoreError
from quern.operators import lexical
from quern.operators import postings as P
from quern.sources.store import ChunkStore

WORDS = ["tram", "ferry", "ticket", "zone", "night", "fare", "dock", "rail", "bus", "pier", "map", "time"]


def texts(n, seed=0):
    import random

    rng = random.Random(seed)
    return [(f"c{i:04d}", " ".join(rng.choices(WORDS, range(12, 0, -1), k=rng.randint(0, 40))) or None, f"d{i // 3}", f"o{i % 4}") for i in range(n)]


def docs(spark, rows):
    return spark.createDataFrame(rows, "id string, text string, document_id string, owner string")


@pytest.fixture(scope="module")
def questions(spark):
    asked = [(1, "night tram zone"), (2, "map map time"), (3, "nothing known"), (4, "tram"), (5, None), (6, "pier dock rail bus fare ticket")]
    return spark.createDataFrame(asked, "query_id long, text string")


def same(found, want):
    order = lambda df: sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))
    got = order(found)
    assert got == order(want)
    return got


def test_searches_equal_a_scan(spark, tmp_path, questions):
    rows = docs(spark, texts(400))
    index = P.PostingIndex(spark, str(tmp_path / "i"))
    with pytest.raises(VectorStoreError):
        index.search(questions)
    index.build(rows)
    assert len(same(index.search(questions, 7), lexical.bm25(rows, questions, 7))) > 20
    same(index.search(questions, 1000, 1.2, 0.75), lexical.bm25(rows, questions, 1000, 1.2, 0.75))
    own = questions.selectExpr("query_id", "text", "case when query_id = 4 then null else concat('o', query_id % 4) end as owner")
    same(index.search(own, 5), lexical.bm25_scoped(rows, own, rows, 5))
    plan = index.search(questions)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("LocalTableScan")[0].split("Scan ExistingRDD")[0] or "text:string" not in "".join(x for x in plan.split("\n") if "FileScan" in x)


def test_pruned_searches_are_exact(spark, tmp_path, monkeypatch, questions):
    monkeypatch.setattr(P, "BLOCK_BITS", 3)
    monkeypatch.setattr(P, "WORTH", 1)
    monkeypatch.setattr(P, "FIRST", 2)
    # long documents of common words, and a few blocks that are much better
    data = texts(600) + [(f"e{i}", " ".join(["night", "map", "pier"][: i % 3 + 1] * 2), f"x{i}", "o1") for i in range(20)]
    rows = docs(spark, data)
    index = P.PostingIndex(spark, str(tmp_path / "i"))
    index.build(rows)
    for k in (1, 3, 10):
        same(index.search(questions, k), lexical.bm25(rows, questions, k))
        same(index.search(questions, k, prune=False), lexical.bm25(rows, questions, k))


def test_refreshes_write_the_changed_documents_only(spark, tmp_path, monkeypatch, questions):
    rows = {d: v for d in texts(120) for v in [d]}
    index = P.PostingIndex(spark, str(tmp_path / "i"))
    index.build(docs(spark, list(rows)))
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "i").rglob("*.parquet")}
    now = list(rows)
    for step, gone in enumerate((["d1", "d7"], ["d7", "d30"], ["d39"])):
        fresh = [(f"c{i}-{step}", "night map " * (i + 1), d, "o2") for i, d in enumerate(gone[:-1])]
        index.update(docs(spark, fresh), spark.createDataFrame([(d,) for d in gone], "document_id string"))
        now = [r for r in now if r[2] not in gone] + fresh
        same(index.search(questions, 9), lexical.bm25(docs(spark, now), questions, 9))
        assert index.state().n_docs == len(now) and index.state().segments[-1].n_docs == len(fresh)
    assert all(p.stat().st_mtime_ns == t for p, t in kept.items())
    index.clean()
    same(index.search(questions, 9), lexical.bm25(docs(spark, now), questions, 9))


def test_an_index_follows_its_store(spark, tmp_path, questions):
    kinds = "document_id string, page_number int, chunk_index int, text string"
    store, index = ChunkStore(spark, str(tmp_path / "s"), buckets=4), P.PostingIndex(spark, str(tmp_path / "i"))
    put = lambda *x: store.replace(spark.createDataFrame([(d, 1, k, t) for d, k, t in x], kinds))
    made = lambda r: r.selectExpr("concat_ws(':', document_id, page_number, chunk_index) as id", "text", "document_id")
    put(*((f"d{i}", k, f"{WORDS[i % 12]} {WORDS[k]}") for i in range(30) for k in range(2)))
    first = index.sync(store, made)
    assert index.sync(store, made) == first and first.source == store.version()
    put(("d3", 0, "night tram"), ("d99", 0, "zone zone"))
    store.delete(spark.createDataFrame([("d4",)], "document_id string"))
    second = index.sync(store, made)
    assert len(second.segments) == 2 and second.segments[1].n_docs == 2 and second.segments[0] == first.segments[0]
    same(index.search(questions, 9), lexical.bm25(made(store.read()), questions, 9))
    store.rebuild(spark.createDataFrame([("z", 1, 0, "night")], kinds))
    assert len(index.sync(store, made).segments) == 1
    same(index.search(questions, 9), lexical.bm25(made(store.read()), questions, 9))


def test_empty_tables(spark, tmp_path, questions):
    index = P.PostingIndex(spark, str(tmp_path / "i"))
    index.build(docs(spark, texts(5)).limit(0))
    assert index.search(questions).collect() == [] and index.state().average == 0.0
    index.update(docs(spark, [("a", "night", "d", "o")]), spark.createDataFrame([("d",)], "document_id string"))
    assert [(r.query_id, r.id, r["rank"]) for r in index.search(questions).collect()] == [(1, "a", 1)]
    assert index.search(questions.limit(0)).collect() == []


def test_pairs_of_questions_and_documents_are_not_shuffled(spark, tmp_path, monkeypatch, questions):
    """They are scored where their block lies, with pruning and without, of one segment and of two."""
    index = P.PostingIndex(spark, str(tmp_path / "i"))

    def dealt_by_pair():
        plan = index.search(questions, 5)._jdf.queryExecution().executedPlan().toString()
        keys = [x.split("Exchange hashpartitioning(")[1].split("plan_id")[0] for x in plan.split("\n") if "Exchange hashpartitioning(" in x]
        assert keys
        return [x for x in keys if "query_id" in x and "block" in x]

    index.build(docs(spark, texts(300)))
    assert dealt_by_pair() == []
    index.update(docs(spark, texts(3)), spark.createDataFrame([("d0",)], "document_id string"))
    assert dealt_by_pair() == []
    monkeypatch.setattr(P, "WORTH", 0)
    assert dealt_by_pair() == []
