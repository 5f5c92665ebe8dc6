import hashlib
import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import bpe

PATH = public_tokenizers.path(bpe.RANKS)
ENC = bpe.encoding_of(PATH, public_tokenizers.PATTERN)
WHOLE = bpe.encoding_of(PATH, bpe.WHOLE)
SCHEMA = "doc_id long, text string, block string, ids string"


def rows():
    rng = random.Random(3)
    alphabet = list("  \n\t 　'sab1²é汉😀.,-\0\x1c") + ["the", " of"]
    made = [(i, "".join(rng.choices(alphabet, k=rng.randint(0, 60)))) for i in range(200)]
    return [*made, (None, "null id"), (300, None), (301, ""), (302, "a   b \n c"), (303, "word " * 30_000), (304, "x" * 20_000), (5, made[5][1]), (5, made[5][1])]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t 'stea1é汉\0\x1c.,_", max_size=30), max_size=4))
def test_cutting_changes_no_ids(texts):
    block = bpe._Block(texts, public_tokenizers.PATTERN)
    for text, own in zip(texts, block.texts, strict=True):
        assert [x for k in own.tolist() for w in block.parts[k] for x in WHOLE.encode_ordinary(w)] == ENC.encode_ordinary(text)


def test_query_equals_the_library(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(bpe, "BUCKET_BYTES", 30_000)
    data = rows()
    spark.createDataFrame([(i, t, "x", "y") for i, t in data], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in bpe.op7_byte_bpe(spark, str(tmp_path)).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(x := ENC.encode_ordinary(t or "")), sha(" ".join(map(str, x)).encode()), sha((t or "").encode())) for i, t in data]
    assert got == sorted(want, key=str)


def test_round_trip_and_no_rows(spark):
    df = spark.createDataFrame(rows()[:40], "doc_id long, text string")
    back = {r.doc_id: bytes(r.text_bytes) for r in bpe.decode(bpe.encode(df)).collect()}
    assert back == {i: t.encode() for i, t in rows()[:40]}
    assert bpe.digests(df.limit(0)).count() == 0
