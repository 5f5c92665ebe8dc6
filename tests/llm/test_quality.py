import binascii

import numpy as np

from quern.llm import quality as Q


def bytes_of(texts):
    parts = [t.encode() for t in texts]
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def stored(spark, tmp_path, docs, labels):
    spark.createDataFrame(docs, "doc_id bigint, text string, score string, lang string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def kept(text, ngrams=Q.NGRAMS):
    """Features by their definition."""
    words = [w for w in bytes(text, "utf8").replace(b"\n", b" ").split(b" ") if w]
    return len(words) + max(0, len(words) - 1) + sum(max(0, len(w) - n + 1) for w in words for n in ngrams)


def test_features_by_their_definition():
    texts = ["a bc", "", "  ", "same same same word", "héé\nx" * 50, "y"]
    data, offsets = bytes_of(texts)
    ids, of = Q.features(data, offsets)
    assert np.bincount(of, minlength=len(texts)).tolist() == [kept(t) for t in texts]
    for k, t in enumerate(texts):
        alone, _ = Q.features(*bytes_of([t]))
        assert sorted(ids[of == k].tolist()) == sorted(alone.tolist())
    again = [Q.features(*bytes_of([t]))[0] for t in ("u u", "vw vw")]
    assert set(again[0]) & set(again[1])


def test_scores_are_the_softmax_of_the_mean():
    rng = np.random.default_rng(0)
    model = Q.Model(rng.standard_normal(1 << Q.BITS).astype(np.float32), 0.3)
    texts = ["one two three", "", "x" * 300_000, "four"]
    data, offsets = bytes_of(texts)
    for t, score in zip(texts, model.scores(data, offsets), strict=True):
        ids, _ = Q.features(*bytes_of([t]))
        logit = 0.3 + (model.weights[ids].astype(float).mean() if len(ids) else 0)
        assert abs(score - 1 / (1 + np.exp(-logit))) < 1e-9


def test_held_out_accuracy(spark, tmp_path):
    rng = np.random.default_rng(3)
    words = ["stone", "river", "walks", "under", "bridge", "quiet", "evening", "light"]
    good = lambda: " ".join(rng.choice(words, 30))
    bad = lambda: " ".join(w + "###" for w in rng.choice(words, 30)) if rng.random() < 0.5 else " ".join([rng.choice(words)] * 30)
    docs = [(i, bad() if i % 5 == 0 else good(), "s", "en") for i in range(400)]
    d = stored(spark, tmp_path, [*docs, (900, None, None, None), (901, "", None, None), (None, "no id", None, None), docs[5]], [(i, int(i % 5 != 0), 0) for i in range(400)] + [(3, None, 0), (None, 1, 0), (5000, 1, 0)])
    rows = Q.op13_quality(spark, d).collect()
    assert len(rows) == 404 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)
    own = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert sum(r.predicted == int(r.doc_id % 5 != 0) for r in own) / len(own) >= 0.97
    empty = {r.doc_id: r.score for r in rows}
    assert empty[900] == empty[901]
    assert len({r.score for r in rows if r.doc_id == 5}) == 1


def test_held_out_labels_teach_nothing(spark, tmp_path):
    out = lambda i: binascii.crc32(str(i).encode()) % 3 == 1
    docs = [(i, f"word{i % 7} other{i % 3}", "s", "en") for i in range(60)]
    a = stored(spark, tmp_path / "a", docs, [(i, i % 2, 0) for i in range(60)])
    b = stored(spark, tmp_path / "b", docs, [(i, 1 - i % 2 if out(i) else i % 2, 0) for i in range(60)])
    of = lambda d: {r.doc_id: r.score for r in Q.op13_quality(spark, d).collect()}
    assert of(a) == of(b)


def test_no_documents_no_labels_and_one_kind(spark, tmp_path):
    docs = [(i, f"text {i}", "s", "en") for i in range(9)]
    assert Q.op13_quality(spark, stored(spark, tmp_path / "a", [], [(1, 1, 0)])).collect() == []
    assert {r.score for r in Q.op13_quality(spark, stored(spark, tmp_path / "b", docs, [])).collect()} == {0.5}
    ones = {r.score for r in Q.op13_quality(spark, stored(spark, tmp_path / "c", docs, [(i, 1, 0) for i in range(9)])).collect()}
    assert len(ones) == 1 and ones.pop() > 0.5


def test_the_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(Q, "SAMPLE", 20)
    monkeypatch.setattr(Q, "SAMPLE_CHARS", 2000)
    seen = []
    monkeypatch.setattr(Q, "fit", lambda sample: seen.append(sample) or Q.Model(np.zeros(1 << Q.BITS, np.float32), 0.0))
    docs = spark.createDataFrame([(i % 10, "word " * 1000) for i in range(3000)], "doc_id bigint, text string")
    Q.trained(docs, spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id bigint, quality int"))
    assert 0 < len(seen[0]) <= 20 and sum(int(n.sum()) for _, n, _ in seen[0]) <= 2 * 2000


def test_other_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a", "x", 2.5)], "doc_id bigint, text string, ids string, weights double")
    out = Q.scored(docs, Q.Model(np.zeros(1 << Q.BITS, np.float32), 0.0), "own")
    assert out.columns == ["doc_id", "text", "ids", "weights", "own"] and out.first().own == 0.5
