import json

import pytest

from quern.config import EngineConfig
from quern.engine import Engine, responses
from quern.errors import EmbeddingError, VectorStoreError
from quern.operators.postings import PostingIndex
from quern.sources.store import ChunkStore

# functions that tasks can have, as they cannot import this module
client = lambda: lambda texts: [[1.0 + t.count("a"), 1.0 + t.count("e")] for t in texts]
scorer = lambda: lambda pairs: [float(len(t)) for _, t in pairs]
chat = lambda: lambda prompt: "It is so [S1][S4]."
pages = lambda: lambda content: content.decode().split("|")


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    store = ChunkStore(spark, str(tmp_path_factory.mktemp("engine") / "chunks"))
    files = spark.createDataFrame([("tram", bytearray(b"trams leave at ten| |night trams")), ("ferry", bytearray(b"the ferry waits")), ("blank", bytearray(b" "))], "document_id string, content binary")
    with pytest.raises(VectorStoreError):
        Engine(store, client).corpus()
    assert [tuple(r) for r in Engine(store, client).index(files, pages)] == [("blank", "no_text")]
    return store


def asked(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id long, text string, scope string")


def test_search_and_scope(spark, store):
    found = Engine(store, client).search(asked(spark, (1, " night  trams ", None), (2, "trams", "ferry")), 3).collect()
    first = next(r for r in found if r.query_id == 1 and r["rank"] == 1)
    assert (first.chunk_id, first.text, first.page_number) == ("tram:3:0", "night trams", 3)
    assert {r.document_id for r in found if r.query_id == 2} == {"ferry"}


def test_settings_decide(spark, store):
    one = asked(spark, (1, "trams", None))
    dense = Engine(store, client, EngineConfig(hybrid=False)).search(one, 2).collect()
    assert len(dense) == 2 and all(r.score is None and r.distance is not None for r in dense)
    again = Engine(store, client, EngineConfig(rerank=True), scorer).search(one, 1).collect()
    assert again[0].text == "trams leave at ten" and again[0].rerank_score == 18.0
    with pytest.raises(ValueError):
        Engine(store, client, EngineConfig(rerank=True))
    for bad in (0, 21):
        with pytest.raises(ValueError):
            Engine(store, client).search(one, bad)
    with pytest.raises(Exception, match="1 to 2000 characters"):
        Engine(store, client).search(asked(spark, (1, "x" * 2001, None)), 1).collect()


def test_answers_and_responses(spark, store):
    with pytest.raises(ValueError):
        Engine(store, client).ask(asked(spark, (1, "trams", None)))
    got = Engine(store, client, chat=chat).ask(asked(spark, (1, "night trams", None), (2, "trams", "unknown")), 2).collect()
    by = {r.query_id: r for r in got}
    assert by[1].answer == "It is so [S1][S4]." and [(c.source_id, c.document_id, c.page_number) for c in by[1].citations] == [("S1", "tram", 3)]
    assert by[2].n_sources == 0 and by[2].citations == []
    told = responses(Engine(store, client).search(asked(spark, (1, "night trams", None)), 2)).collect()
    body = json.loads(told[0].response)
    assert body["result_count"] == 2 and [r["rank"] for r in body["results"]] == [1, 2] and body["results"][0]["chunk_id"] == "tram:3:0"


def test_questions_are_embedded_once(spark, store, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def counting():
        import uuid

        return lambda texts: [(calls / uuid.uuid4().hex).write_text(t) and [1.0 + t.count("a"), 1.0 + t.count("e")] for t in texts]

    sent = lambda: sorted(p.read_text() for p in calls.iterdir())
    two = asked(spark, (1, "night trams", None), (2, "the ferry", "ferry"))
    engine = Engine(store, counting, EngineConfig(rerank=True), scorer, chat, PostingIndex(spark, str(tmp_path / "index")))
    with_index = sorted(tuple(r) for r in engine.search(two, 3).collect())
    assert sent() == ["night trams", "the ferry"]
    plain = Engine(store, client, EngineConfig(rerank=True), scorer, chat)
    assert with_index == sorted(tuple(r) for r in plain.search(two, 3).collect())
    assert len(engine.ask(two, 2).collect()) == 2 and sent() == ["night trams", "night trams", "the ferry", "the ferry"]


def test_settings_reach_the_models(spark, store, tmp_path):
    warm = lambda temperature: lambda prompt: f"at {temperature} [S1]"
    one = asked(spark, (1, "night trams", None))
    assert Engine(store, client, EngineConfig(temperature=0.7), chat=warm).ask(one).first().answer == "at 0.7 [S1]"
    with pytest.raises(EmbeddingError, match="another"):
        Engine(store, client, EngineConfig(embedding_model="another")).search(one)
    big = spark.createDataFrame([("a.pdf", None, bytearray(b"%PDF-" + b"x" * (2 << 20)))], "filename string, content_type string, content binary")
    good, bad = Engine(store, client, EngineConfig(max_upload_mb=1)).upload(big, str(tmp_path / "u"))
    assert good.count() == 0 and bad.first().reject_reason == "size"


def test_rebuilding_drops_what_was_there(spark, tmp_path):
    files = lambda *x: spark.createDataFrame([(d, bytearray(t)) for d, t in x], "document_id string, content binary")
    own = ChunkStore(spark, str(tmp_path / "c"))
    engine = Engine(own, client)
    engine.index(files(("a", b"old words"), ("b", b"more")), pages)
    assert [tuple(r) for r in engine.rebuild(files(("c", b"new words"), ("d", b" ")), pages)] == [("d", "no_text")]
    assert [r.document_id for r in own.read().collect()] == ["c"]
