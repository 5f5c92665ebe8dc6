import hashlib
import math
import re
from pathlib import Path

import pytest
import zstandard
from test_decontaminate import brute_force as holds
from test_minhash import brute_force as groups

import corpus_pipeline
from quern.llm import bpe, pii, toxicity
from quern.llm.common import written
from test_toxicity import rows as toxic_rows

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, hits string, count int, kept boolean, id string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    data = toxic_rows(400)
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"), (2, None)]
    docs = [(i, t) for i, t, _ in data]
    docs += [(1000 + i, t + " end") for i, t, _ in data[:60]] + [(2000, data[1][1]), (None, data[2][1]), (2001, None), (2002, "")]
    docs += [(3000, "before it " + items[0][1] + " and after"), (3001, "mail me at some.body@example.org today"), (3, data[3][1])]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.9, "h", 7, False, "i") for i, t in docs], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in data], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), docs, items, data


def plain_score(model, text):
    """A text's score by one compression for each window and dictionary, with the library's plain interface."""
    saved, words = [], text.lower().split()
    for k in range(0, len(words), toxicity.WINDOW):
        window = f" {' '.join(words[k : k + toxicity.WINDOW])} "
        for at in range(0, len(window), toxicity.LONGEST):
            part = window[at : at + toxicity.LONGEST].encode()
            sizes = []
            for data in model.dictionaries:
                of = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                sizes.append(len(zstandard.ZstdCompressor(level=toxicity.LEVEL, dict_data=of, write_checksum=False, write_content_size=False, write_dict_id=False).compress(part)))
            saved.append(sizes[0] - sizes[1])
    hits = sum(s >= toxicity.SAVED for s in saved)
    x = [1, min(max(max(saved), 0), 12), math.log1p(hits), hits / len(saved)] if saved else [1, 0, 0, 0]
    return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(x, model.weights, strict=True))))))


def test_each_stage_against_brute_force(spark, folder):
    path, docs, items, data = folder
    key = lambda r: str((r[0], r[1]))
    frame = spark.read.parquet(f"{path}/documents.parquet")
    kept = [(i, t) for i, t in docs]

    model = toxicity.trained(frame.select("doc_id", "text"), spark.read.parquet(f"{path}/labels.parquet"))
    out = corpus_pipeline.toxic_out(spark, frame, path)
    kept = [(i, t) for i, t in kept if plain_score(model, t or "") < 0.5]
    toxic = {i for i, _, y in data if y}
    assert sum(i in toxic for i, _ in kept) < 0.1 * len(toxic) and sum(i is not None and i < 400 and i not in toxic for i, _ in kept) > 0.95 * (400 - len(toxic))
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=key) == sorted(kept, key=key) and out.columns == frame.columns

    frame = written(out, "test")
    out = corpus_pipeline.near_duplicates_out(spark, frame, path)
    stay = {i for i, _, _, k in groups(kept, 5, 80) if k}
    kept = list({(i, t): None for i, t in kept if i is None or i in stay})
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=key) == sorted(kept, key=key) and out.columns == frame.columns

    frame = written(out, "test")
    out = corpus_pipeline.contaminated_out(spark, frame, path)
    held = holds(kept, [(i, t, None) for i, t in items])
    kept = [x for x, h in zip(kept, held, strict=True) if not h[1]]
    assert 3000 not in [i for i, _ in kept] and len(kept) > 200
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=key) == sorted(kept, key=key) and out.columns == frame.columns

    frame = written(out, "test")
    out = corpus_pipeline.personal_data_redacted(spark, frame, path)
    kept = [(i, None if t is None else pii.redact(t, pii.spans(t))) for i, t in kept]
    assert (3001, "mail me at [EMAIL] today") in kept
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=key) == sorted(kept, key=key) and out.columns == frame.columns

    frame = written(out, "test")
    encode = bpe.encoding_of(bpe.public_tokenizers.path(bpe.RANKS), bpe.public_tokenizers.PATTERN).encode_ordinary
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, len(encode(t or "")), encode(t or ""), sha(t or "")) for i, t in kept]
    got = [tuple(r) for r in corpus_pipeline.encoded(spark, frame, path).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    shared = Path(re.sub("^file:/*", "/", corpus_pipeline.shared_dir(spark)))
    before = {x.name for x in shared.iterdir()}
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, path).collect()), key=key) == sorted(want, key=key)
    left = {x.name for x in shared.iterdir()} - before
    assert len(left) == 1 and "stage-personal_data" in left.pop()  # which the result reads


def test_rows_of_one_doc_id_stay_unless_they_are_near_copies(spark, tmp_path):
    text = lambda name, n=60: " ".join(f"{name}{k}" for k in range(n))
    docs = [(1, text("a")), (2, text("a") + " end"), (2, text("b")), (3, text("c")), (3, text("d")), (3, text("d")), (3, text("d") + " end")]
    docs += [(4, text("b")), (5, ""), (5, None), (5, text("e")), (6, text("f")), (None, text("a")), (7, text("a")), (7, text("a") + " more")]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.9, "h", 7, False, "i") for i, t in docs], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.near_duplicates_out(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path))
    want = [(1, text("a")), (2, text("b")), (3, text("c")), (3, text("d")), (5, None), (5, text("e")), (6, text("f")), (None, text("a"))]
    assert sorted([(r.doc_id, r.text) for r in out.collect()], key=str) == sorted(want, key=str)


@pytest.mark.parametrize("names", [["_quern", "_redacted", "_text"], ["_N", "_set", "_component", "_score", "_hits"], ["h", "ids", "score0", "_redacted1", "_TEXT"]])
def test_columns_with_any_names_stay(spark, tmp_path, names):
    docs = [(1, "mail a.b@example.org now please", "x"), (1, "other words of the same id here", "y"), (2, None, "z")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", *(f"'{c}' as `{c}`" for c in names))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = frame
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, str(tmp_path)), "test")
        assert now.columns == frame.columns
    got = now.collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == [(1, "mail [EMAIL] now please"), (1, "other words of the same id here"), (2, "")]
    assert all(r[c] == c for r in got for c in names)


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]
