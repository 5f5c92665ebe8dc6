import random
import zlib

import numpy as np

from quern.llm import toxicity as tx

BAD = ["nasty", "vile", "rotten", "horrid"]


def rows(n=600):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghilmnorstu", k=rng.randint(2, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        words = rng.choices(vocab, k=rng.randint(10, 120))
        toxic = i % 5 == 0
        for _ in range(rng.randint(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        out.append((i, " ".join(words), int(toxic)))
    return out


def test_held_out_accuracy(spark, tmp_path):
    data = rows()
    docs = [(i, t, "x", 0.5) for i, t, _ in data] + [(None, None, "x", 1.0), (9001, "", "x", 1.0), (3, data[3][1], "x", 1.0), (9002, "a" * 50_000, "x", 1.0)]
    spark.createDataFrame(docs, "doc_id long, text string, toxic string, score double").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, y) for i, _, y in data] + [(None, 1), (9001, None), (0, 0)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = tx.op5_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 600]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) / len(held) >= 0.95
    assert all(r.predicted == 0 for r in got if r.doc_id in (None, 9001, 9002))


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in tx.scored(docs, tx.trained(docs, labels)).collect()] == [0.0]
    assert tx.scored(docs.limit(0), tx.trained(docs.limit(0), labels)).count() == 0


def test_long_labelled_texts_do_not_end_the_sample(spark, monkeypatch):
    data = rows()
    known = [(i, y) for i, _, y in data]
    most = sum(len(t) for _, t, _ in data) + 4_000
    monkeypatch.setattr(tx, "SAMPLE_CHARS", most)
    seen = []
    fit = tx.fit
    monkeypatch.setattr(tx, "fit", lambda sample: seen.append(sample) or fit(sample))
    long = [(i, " ".join(f"w{k % 9000}" for k in range(most // 4)), 0) for i in range(10_000, 10_010)]
    assert all(len(t) > most for _, t, _ in long)
    docs = spark.createDataFrame([x[:2] for x in data + long], "doc_id long, text string")
    model = tx.trained(docs, spark.createDataFrame(known + [(i, y) for i, _, y in long], "doc_id long, toxic int"))
    (sample,) = seen
    drawn = {i for i, _, _ in data + long if zlib.crc32(str(i).encode()) % 5}
    assert len(sample) == len(drawn) and most * 0.9 < sum(len(t) for t, _ in sample) <= most
    assert {t for i, t, _ in data if i in drawn} <= {t for t, _ in sample}
    scores = model.scores([t for _, t, _ in data])
    assert sum((s >= 0.5) == y for s, (_, _, y) in zip(scores, data, strict=True)) / len(data) >= 0.95


def test_features_are_differences_of_compressed_lengths():
    """Each window by itself under each dictionary, by the library's plain interface."""
    import math

    import zstandard as z

    data = rows()
    model = tx.fit([(t, y) for _, t, y in data])
    assert len(model.dictionaries) == 2 and model.dictionaries[1].endswith(model.dictionaries[0])
    assert all(f" {w} ".encode() in model.dictionaries[1] or w.encode() in model.dictionaries[1] for w in BAD)

    def size(window, dictionary):
        kept = z.ZstdCompressionDict(dictionary, dict_type=z.DICT_TYPE_RAWCONTENT)
        return len(z.ZstdCompressor(level=tx.LEVEL, dict_data=kept, write_checksum=False, write_content_size=False, write_dict_id=False).compress(window))

    for _, text, _ in data[:40]:
        saved = []
        words = text.lower().split()
        for k in range(0, len(words), tx.WINDOW):
            whole = f" {' '.join(words[k : k + tx.WINDOW])} "
            for at in range(0, len(whole), tx.LONGEST):
                part = whole[at : at + tx.LONGEST].encode()
                saved.append(size(part, model.dictionaries[0]) - size(part, model.dictionaries[1]))
        hits = sum(s >= tx.SAVED for s in saved)
        want = [1, min(max(max(saved), 0), 12), math.log1p(hits), hits / len(saved)]
        assert np.allclose(model.features([text])[0], want)
        assert np.isclose(model.scores([text])[0], 1 / (1 + math.exp(-np.clip(np.dot(want, model.weights), -30, 30))))


def test_calibrating_rows_train_no_dictionary(monkeypatch):
    seen = []
    dictionary = tx.dictionary
    monkeypatch.setattr(tx, "dictionary", lambda own, kind: seen.append(b" ".join(own).decode()) or dictionary(own, kind))
    marked = [(f"mark{k}x " * 12 + t, y) for k, (_, t, y) in enumerate(rows())]
    tx.fit(marked)
    trained = {k for k in range(len(marked)) if f"mark{k}x" in seen[0]}  # of ordinary texts
    ordinary = [k for k, (_, y) in enumerate(marked) if not y]
    assert 0.5 < len(trained) / len(ordinary) < 0.7 and trained <= set(ordinary)


def test_windows_spread_over_a_text():
    text = " ".join(f"w{k}" for k in range(10_000))
    got = tx.spread(text, 5_000)
    assert 4_500 < len(got) <= 5_000 and got.split()[0] == "w0" and int(got.split()[-1][1:]) > 9_700
    assert set(tx.windows(got)) <= set(tx.windows(text))
    assert tx.spread(text, len(text)) == text and tx.spread(" " * 9_000, 4_000) == "" and 0 < len(tx.spread("a" * 90_000, 4_000)) <= 4_000
    assert tx.share_of([1, 2, 3], 6) >= 3 and tx.share_of([1, 50, 50], 61) == 30 and tx.share_of([], 5) == 5
