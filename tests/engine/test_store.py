import threading

import pytest
from pyspark.sql import functions as F

from quern.errors import EmbeddingError, VectorStoreError
from quern.sources import store as S
from quern.sources.indexing import fresh_chunks
from quern.sources.store import ChunkStore

KINDS = "document_id string, page_number int, chunk_index int, text string, token_count int, embedding array<float>"


def rows(spark, *parts, model=None):
    df = spark.createDataFrame([(d, 1, k, t, 1, [1.0, 2.0]) for d, k, t in parts], KINDS)
    return df if model is None else df.withColumn("embedding_model", F.lit(model))


def held(store, version=None):
    return sorted((r.document_id, r.chunk_index, r.text) for r in store.read(version).collect())


def files(tmp_path):
    return {str(p) for p in (tmp_path / "c" / "data").rglob("*.parquet")}


def test_a_replacement_writes_one_bucket(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "c"), buckets=8)
    first = store.replace(rows(spark, *((f"d{i}", k, "old") for i in range(40) for k in range(2))))
    before = files(tmp_path)
    store.replace(rows(spark, ("d3", 0, "new")))
    added = files(tmp_path) - before
    assert before <= files(tmp_path) and len({p.split("bucket=")[1].split("/")[0] for p in added}) == 1
    now = held(store)
    assert len(now) == 79 and ("d3", 0, "new") in now and not any(d == "d3" and t == "old" for d, _, t in now)
    assert len(held(store, first)) == 80
    # only that bucket's rows meet the later layer
    plan = store.read()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "Union" in plan
    assert sorted(map(tuple, store.read_documents(["d3", "d4"]).select("document_id", "text").collect())) == [("d3", "new"), ("d4", "old"), ("d4", "old")]


def test_layers_deletions_and_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "MOST_LAYERS", 3)
    store = ChunkStore(spark, str(tmp_path / "c"), buckets=2)
    store.replace(rows(spark, *((f"d{i}", 0, "0") for i in range(9))))
    want = {f"d{i}": "0" for i in range(9)}
    for n in range(1, 9):
        ids = [f"d{n % 9}", f"d{(n * 5) % 9}", f"new{n}"]
        store.replace(rows(spark, *((d, 0, str(n)) for d in dict.fromkeys(ids))))
        want |= {d: str(n) for d in ids}
        if n % 4 == 0:
            store.delete(spark.createDataFrame([(ids[0],), ("never there",)], "document_id string"))
            want.pop(ids[0])
        assert {d: t for d, _, t in held(store)} == want and len(held(store)) == len(want)
        depth = {}
        for x in store.manifest(store.version()).layers:
            for b in x.buckets:
                depth[b] = depth.get(b, 0) + 1
        assert max(depth.values()) <= 4
    assert store.compact() and {d: t for d, _, t in held(store)} == want and store.compact() is None
    assert all(len(x.buckets) for x in store.manifest(store.version()).layers)
    kept = held(store)
    store.clean(1)
    assert held(store) == kept and store.sweep() == []


@pytest.mark.parametrize("when", ["before_commit", "after_read", "in_compaction"])
def test_writers_that_interleave_lose_nothing(spark, tmp_path, monkeypatch, when):
    """Another writer commits at each point of this one's work."""
    one, other = (ChunkStore(spark, str(tmp_path / "c"), buckets=2) for _ in range(2))
    one.replace(rows(spark, ("a", 0, "a0"), ("b", 0, "b0")))
    done = []

    def meanwhile(*_):
        if not done:
            done.append(1)
            other.replace(rows(spark, ("b", 0, "b1"), ("c", 0, "c1")))

    if when == "before_commit":
        create = one._create
        monkeypatch.setattr(one, "_create", lambda *a: (meanwhile(), create(*a))[1])
    elif when == "after_read":
        current = one.current
        monkeypatch.setattr(one, "current", lambda: (current(), meanwhile())[0])
    else:
        put = one._put
        one.replace(rows(spark, ("a", 0, "a1")))
        monkeypatch.setattr(one, "_put", lambda *a, **k: (put(*a, **k), meanwhile())[0])
        one.compact()
        assert held(one) == [("a", 0, "a1"), ("b", 0, "b1"), ("c", 0, "c1")]
        return
    one.replace(rows(spark, ("a", 0, "a2"), ("d", 0, "d2")))
    assert held(one) == held(other) == [("a", 0, "a2"), ("b", 0, "b1"), ("c", 0, "c1"), ("d", 0, "d2")]


def test_many_writers_at_once(spark, tmp_path):
    stores = [ChunkStore(spark, str(tmp_path / "c"), buckets=2) for _ in range(4)]
    threads = [threading.Thread(target=lambda s=s, k=k: s.replace(rows(spark, (f"d{k}", 0, "x"), ("all", 0, str(k))))) for k, s in enumerate(stores)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = held(stores[0])
    assert [d for d, _, _ in got] == ["all", "d0", "d1", "d2", "d3"]


def test_a_version_is_created_once(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "c"))
    assert store._create("log/x.json", "first") and not store._create("log/x.json", "second")
    assert store._read("log/x.json") == "first" and store._list("drafts") == []


def test_rebuild_and_changes(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "c"), buckets=4)
    first = store.replace(rows(spark, ("a", 0, "1"), ("b", 0, "1"), model="m"))
    second = store.replace(rows(spark, ("b", 0, "2"), model="m"))
    store.delete(spark.createDataFrame([("a",)], "document_id string"))
    ids = lambda v: sorted(r.document_id for r in store.changes(v).collect())
    assert ids(first) == ["a", "b"] and ids(second) == ["a"] and ids(store.version()) == []
    assert [(r.document_id, r.text) for r in store.fresh(first).collect()] == [("b", "2")] and store.fresh(second).count() == 0
    with pytest.raises(VectorStoreError, match="another writer"):
        store.write(rows(spark, ("z", 0, "1"), model="n"), after=first)
    store.rebuild(rows(spark, ("z", 0, "1"), model="n"))
    assert held(store) == [("z", 0, "1")] and store.changes(first) is None and store.manifest(store.version()).model == "n"


def test_vectors_of_another_model_are_an_error(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "c"))
    store.replace(rows(spark, ("a", 0, "1"), model="m"))
    for bad in (rows(spark, ("b", 0, "1"), model="n"), rows(spark, ("b", 0, "1"), model="m").unionByName(rows(spark, ("c", 0, "1"), model="n"))):
        with pytest.raises(EmbeddingError, match="model"):
            store.replace(bad)
    assert held(store) == [("a", 0, "1")] and len(list((tmp_path / "c" / "data").iterdir())) == 1
    assert {r.embedding_model for r in store.read().collect()} == {"m"}


def test_an_empty_replacement_changes_nothing(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "c"))
    store.replace(rows(spark).limit(0))
    assert held(store) == []
    store.replace(rows(spark, ("a", 0, "1")))
    store.replace(rows(spark).limit(0))
    store.replace(rows(spark, ("a", 0, "1")).where("text = 'none'"))
    assert held(store) == [("a", 0, "1")]


def test_indexing_calls_the_client_once_for_each_chunk(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def client():
        import uuid

        return lambda texts: [(calls / uuid.uuid4().hex).write_text(t) and [1.0] for t in texts]

    pages = lambda: lambda content: content.decode().split("|")
    data = spark.createDataFrame([("a", bytearray(b"one two|three")), ("b", bytearray(b" ")), ("c", bytearray(b"four"))], "document_id string, content binary")
    store = ChunkStore(spark, str(tmp_path / "c"))
    made = store.replace(fresh_chunks(data.repartition(2), pages, client, 1, 0, model="m"))
    assert sorted(p.read_text() for p in calls.iterdir()) == ["four", "one", "three", "two"]
    assert [tuple(r) for r in store.rejects(made).collect()] == [("b", "no_text")]
    assert sorted((r.document_id, r.page_number, r.chunk_index, r.text, r.token_count) for r in store.read().collect()) == [("a", 1, 0, "one", 1), ("a", 1, 1, "two", 1), ("a", 2, 0, "three", 1), ("c", 1, 0, "four", 1)]
    # a document that can be read no more keeps its chunks
    store.replace(fresh_chunks(spark.createDataFrame([("a", bytearray(b" "))], "document_id string, content binary"), pages, client, model="m"))
    assert store.read().where("document_id = 'a'").count() == 3
