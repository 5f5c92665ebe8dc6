import pytest

from quern.errors import EmbeddingError, MissingDocumentError, VectorStoreError
from quern.sources import beir, documents, embedding
from quern.sources.store import ChunkStore
from quern.streaming.ingest import ingest_stream


# lambdas, as tasks cannot import this module
extractor = lambda: lambda content: content.decode().removeprefix("%PDF-").split("\f")
client = lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]


def test_validation(spark):
    pdf = bytearray(b"%PDF-2.0\nany body will do")
    rows = [
        ("Fares.PDF", "application/pdf", pdf, None),
        ("a.pdf", None, pdf, None),
        ("a.pdf", "", pdf, None),
        ("fares.csv", "text/plain", bytearray(b""), "extension"),
        (None, "application/pdf", pdf, "extension"),
        ("a.pdf", "text/plain", pdf, "mime"),
        ("a.pdf", "application/x-pdf", bytearray(b""), "empty"),
        ("a.pdf", None, None, "empty"),
        ("a.pdf", None, bytearray(b"%PDF-" + b"x" * 1024 * 1024), "size"),
        ("a.pdf", None, bytearray(b"PK\x03\x04 an archive"), "signature"),
    ]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "filename string, content_type string, content binary, want string, n int")
    good, bad = documents.validated(df, 1)
    assert {r.n for r in good.collect()} == {0, 1, 2} and all(r.reject_reason == r.want for r in bad.collect()) and bad.count() == 7


def test_pages_keep_their_numbers(spark):
    pages = spark.createDataFrame([("d", 1, "\tA tram runs "), ("d", 2, " \n "), ("d", 3, "by night."), ("e", 1, None)], "document_id string, page_number int, text string")
    assert sorted(map(tuple, documents.page_scan(pages).collect())) == [("d", 1, "A tram runs"), ("d", 3, "by night.")]
    files = spark.createDataFrame([("d", bytearray(b"%PDF-\tA tram runs \f \fby night."))], "document_id string, content binary")
    assert sorted(map(tuple, documents.extracted(files, extractor).collect())) == [("d", 1, "A tram runs"), ("d", 3, "by night.")]
    blank = spark.createDataFrame([("d", bytearray(b"%PDF- \f "))], "document_id string, content binary")
    with pytest.raises(Exception, match="no pages: d no_text"):
        documents.extracted(blank, extractor).collect()
    cut = documents.document_chunks(pages, 2, 0)
    assert sorted((r.page_number, r.chunk_index, r.text) for r in cut.collect()) == [(1, 0, "A tram"), (1, 1, "runs"), (3, 0, "by night.")]
    stats = {r.document_id: tuple(r)[1:] for r in documents.document_stats(pages, cut).collect()}
    assert stats == {"d": (2, 3, 5), "e": (0, 0, 0)}


def test_one_bad_file_ends_no_job(spark):
    def load():
        from quern.errors import EncryptedPdfError

        def pages(content):
            if content == b"locked":
                raise EncryptedPdfError("a password is needed")
            return content.decode().split("|")

        return pages

    files = spark.createDataFrame([("a", bytearray(b"one||two")), ("b", bytearray(b"locked")), ("c", bytearray(b"\xff")), ("d", bytearray(b" | ")), ("e", None)], "document_id string, content binary")
    got = sorted(map(tuple, documents.extraction(files, load).collect()), key=str)
    assert got == sorted([("a", 1, "one", None), ("a", 3, "two", None), ("b", None, None, "encrypted"), ("c", None, None, "unreadable"), ("d", None, None, "no_text"), ("e", None, None, "unreadable")], key=str)
    assert documents.extraction(files.limit(0), load).count() == 0


def test_uploads_are_stored(spark, tmp_path):
    rows = [("a.pdf", None, bytearray(b"%PDF-x")), ("b.txt", None, bytearray(b"%PDF-x")), ("c.pdf", None, bytearray(b"none"))]
    df = spark.createDataFrame(rows, "filename string, content_type string, content binary")
    good, bad = documents.store_uploads(df, f"{tmp_path}/uploads")
    assert [(r.filename, bytes(r.content), len(r.document_id)) for r in good.collect()] == [("a.pdf", b"%PDF-x", 36)]
    assert good.first().document_id == good.first().document_id
    assert sorted((r.filename, r.size, r.reject_reason) for r in bad.collect()) == [("b.txt", 6, "extension"), ("c.pdf", 4, "signature")]
    good, bad = documents.store_uploads(df.limit(0), f"{tmp_path}/uploads")
    assert (good.count(), bad.count()) == (1, 2)


def test_missing(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "document_id string")
    assert [r.document_id for r in documents.missing(ids("a", "b", "b"), ids("a")).collect()] == ["b"]
    documents.require(ids("a"), ids("a"))
    with pytest.raises(MissingDocumentError):
        documents.require(ids("z"), ids("a"))


def test_store_replaces_whole_documents(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "chunks"))
    with pytest.raises(VectorStoreError):
        store.read()
    rows = lambda *x: spark.createDataFrame([(d, 1, k, t, 1, [1.0]) for d, k, t in x], "document_id string, page_number int, chunk_index int, text string, token_count int, embedding array<float>")
    store.replace(rows(("a", 0, "old"), ("a", 1, "old"), ("b", 0, "kept")))
    first = store.version()
    store.replace(rows(("a", 0, "new")))
    assert store.version() > first
    assert sorted((r.chunk_id, r.text, r.distance) for r in store.all_chunks().collect()) == [("a:1:0", "new", None), ("b:1:0", "kept", None)]


CHUNKS = "document_id string, page_number int, chunk_index int, text string, token_count int, embedding array<float>"


def test_a_failing_read_loses_no_documents(spark, tmp_path):
    """Only a table that is not there is empty; a damaged one is an error, and nothing is written."""
    store = ChunkStore(spark, str(tmp_path / "chunks"))
    rows = lambda d, v=(1.0,): spark.createDataFrame([(d, 1, 0, d, 1, None if v is None else list(v))], CHUNKS)
    store.replace(rows("a"))
    (log,) = (tmp_path / "chunks" / "log").glob("*.json")
    whole = log.read_text()
    for damaged in ("", whole[: len(whole) // 2], "{}"):
        log.write_text(damaged)
        with pytest.raises(VectorStoreError, match="lost"):
            store.replace(rows("b"))
    log.write_text(whole.replace("data/", "data/not-there-"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        store.read()
    log.write_text(whole)
    assert [r.document_id for r in store.read().collect()] == ["a"] and len(list((tmp_path / "chunks" / "data").iterdir())) == 1


def test_replacement_is_checked_before_it_is_written(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "chunks"))
    rows = lambda *x: spark.createDataFrame([(d, 1, 0, d, 1, v) for d, v in x], CHUNKS)
    for bad in (rows(("a", None)), rows(("a", [])), rows(("a", [1.0]), ("b", [1.0, 2.0])), rows(("a", [1.0]), ("b", None))):
        with pytest.raises(EmbeddingError):
            store.replace(bad)
    assert store.find_version() is None
    store.replace(rows(("a", [1.0, 2.0])))
    with pytest.raises(EmbeddingError, match="stored"):
        store.replace(rows(("b", [1.0])))
    assert [r.document_id for r in store.read().collect()] == ["a"]


def test_two_writers_and_old_versions(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "chunks"))
    rows = lambda d: spark.createDataFrame([(d, 1, 0, d, 1, [1.0])], CHUNKS)
    first = store.replace(rows("a"))
    assert not store.changed(first)
    second = store.replace(rows("b"))
    assert store.changed(first)
    with pytest.raises(VectorStoreError, match="another writer"):
        store.write(rows("c"), after=first)
    assert store.version() == second and sorted(r.document_id for r in store.read().collect()) == ["a", "b"]
    store.replace(rows("c"))
    assert store.clean(2) == [first] and store.clean(2) == [] and store.read().count() == 3


def test_embedding(spark):
    seen = []
    assert embedding.embed_texts(lambda x: seen.append(x) or [[float(len(t))] for t in x], ["a", "bb", "ccc"], 2) == [[1.0], [2.0], [3.0]]
    assert seen == [["a", "bb"], ["ccc"]] and embedding.embed_texts(client(), []) == []
    with pytest.raises(ValueError):
        embedding.embed_texts(client(), ["a"], 0)
    for bad in (lambda x: [], lambda x: [[1.0]] * (len(x) - 1) + [[1.0, 2.0]], lambda x: [[] for _ in x], lambda x: 1 / 0):
        with pytest.raises(EmbeddingError):
            embedding.embed_texts(bad, ["a", "b"])
    df = spark.createDataFrame([(1, "abc")], "id long, text string")
    assert [tuple(r) for r in embedding.embedded(df, client).collect()] == [(1, "abc", [3.0, 1.0])]


def test_benchmark_files(spark, tmp_path):
    (tmp_path / "corpus.jsonl").write_text('{"_id": "1", "title": " T ", "text": " body "}\n\n{"_id": "2", "title": null, "text": "only"}\n{"_id": "3", "title": "", "text": " "}\n{"_id": "4", "title": "t"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id": "q10", "text": "ten"}\n{"_id": "q2", "text": "two"}\n{"_id": "q3", "text": "no judgement"}\n')
    (tmp_path / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq10\t1\t2\nq2\t2\t1\nq3\t2\t0\n")
    assert sorted(map(tuple, beir.corpus_scan(spark, str(tmp_path / "corpus.jsonl")).collect())) == [("1", "T\nbody"), ("2", "only"), ("4", "t")]
    assert beir.corpus_scan(spark, str(tmp_path / "corpus.jsonl"), 2).count() == 2 and beir.corpus_scan(spark, str(tmp_path / "corpus.jsonl"), 0).count() == 3
    qrels = beir.qrels_scan(spark, str(tmp_path / "test.tsv"))
    assert sorted(map(tuple, qrels.collect())) == [("q10", "1", 2), ("q2", "2", 1)]
    (tmp_path / "again.tsv").write_text("query-id\tcorpus-id\tscore\nq2\t2\t3\nq2\t2\t1\nq2\t2\t0\n")
    assert list(map(tuple, beir.qrels_scan(spark, str(tmp_path / "again.tsv")).collect())) == [("q2", "2", 1)]
    for bad in ("q\t1", "q\t1\t2\tmore", "q\t1\thigh"):
        (tmp_path / "bad.tsv").write_text(f"query-id\tcorpus-id\tscore\n{bad}\n")
        with pytest.raises(Exception, match="not a judgement"):
            beir.qrels_scan(spark, str(tmp_path / "bad.tsv")).collect()
    (tmp_path / "twice.jsonl").write_text('{"_id": "q2", "text": "early"}\n{"_id": "q10", "text": "ten"}\n{"_id": "q2", "text": "late"}\n')
    assert sorted(map(tuple, beir.queries_scan(spark, str(tmp_path / "twice.jsonl"), qrels).collect())) == [("q10", "ten"), ("q2", "late")]
    assert [r.id for r in beir.corpus_scan(spark, str(tmp_path / "corpus.jsonl"), 2).collect()] == ["1", "2"]
    queries = beir.queries_scan(spark, str(tmp_path / "queries.jsonl"), qrels)
    assert [r.query_id for r in beir.first_queries(queries, 1).collect()] == ["q10"] and beir.first_queries(queries, None).count() == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    store = ChunkStore(spark, str(tmp_path / "store"))
    run = lambda: ingest_stream(spark, str(tmp_path / "in"), store, str(tmp_path / "ck"), extractor, client, 2, 0).awaitTermination()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF-one two three")
    run()
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF-four\f\ffive")
    (tmp_path / "in" / "c.pdf").write_bytes(b"%PDF- \f ")
    run()
    assert [tuple(r)[:2] for r in spark.read.parquet(f"{tmp_path}/store/rejects").collect()] == [("c", "no_text")]
    assert sorted((r.document_id, r.page_number, r.text) for r in store.read().collect()) == [("a", 1, "one two"), ("a", 1, "three"), ("b", 1, "four"), ("b", 3, "five")]


def test_pages_from_sql(spark):
    files = spark.createDataFrame([("a", bytearray(b"one\f\ftwo")), ("b", bytearray(b" ")), ("c", None)], "document_id string, content binary")
    files.createOrReplaceTempView("files_of_pages")
    spark.udtf.register("pages", documents.page_table(extractor))
    got = spark.sql("SELECT f.document_id, p.* FROM files_of_pages f, LATERAL pages(f.content) p")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, documents.extraction(files, extractor).collect()), key=str)
    for bad in ("'text'", "1", "array(f.content)"):
        with pytest.raises(Exception, match="bytes of a file"):
            spark.sql(f"SELECT p.* FROM files_of_pages f, LATERAL pages({bad}) p").collect()


def test_a_model_gets_each_text_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def counting():
        import uuid

        return lambda texts: [(calls / uuid.uuid4().hex).write_text(t) and [float(len(t))] for t in texts]

    sent = lambda: sorted(p.read_text() for p in calls.iterdir())
    cache = embedding.EmbeddingCache(spark, str(tmp_path / "cache"))
    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None), (5, "")], "id long, text string")
    assert sorted((r.id, r.embedding) for r in cache.embedded(rows.where("id < 5"), counting, "m").collect()) == [(1, [1.0]), (2, [2.0]), (3, [1.0]), (4, None)]
    assert sent() == ["a", "bb"]
    more = rows.where("id < 5").unionByName(spark.createDataFrame([(9, "ccc")], rows.schema))
    again = embedding.EmbeddingCache(spark, str(tmp_path / "cache")).embedded(more, counting, "m")
    assert again.where("id = 9").first().embedding == [3.0] and sent() == ["a", "bb", "ccc"]
    assert cache.embedded(rows.where("id = 2"), counting, "other").first().embedding == [2.0] and sent() == ["a", "bb", "bb", "ccc"]
    assert cache.embedded(rows.limit(0), counting, "m").collect() == []
