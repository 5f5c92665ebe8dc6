import random
import zlib

import numpy as np
import public_tokenizers
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quern.llm import token_files as tf


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=300))
def test_select(lengths):
    ends = np.cumsum(np.array(lengths, np.int64))
    code = tf.Boundaries.of(ends)
    assert code.all().tolist() == ends.tolist() == [code.select_end(k) for k in range(len(ends))]
    if len(ends) > 50:
        assert 8 * (len(code.low) + len(code.high)) <= len(ends) * (code.l + 3) + 16


def test_query_equals_the_library(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "SHARD_DOCS", 40)
    monkeypatch.setattr(tf, "SHARD_IDS", 500)
    rng = random.Random(4)
    alphabet = list("  \n\t 'sab1²é汉😀.,-") + ["the", " of", "<|endoftext|>"]
    rows = [(rng.randrange(1000), "".join(rng.choices(alphabet, k=rng.randint(0, 60)))) for _ in range(300)]
    rows += [(None, "null id"), (2000, None), (2001, ""), (-5, "word " * 9000), (3000, " ".join(f"w{chr(97 + k % 26)}{chr(192 + k % 90)}{chr(97 + k // 26 % 26)}" + ".,\n"[k % 3] for k in range(2000))), (7, "tie"), (7, "tie"), (7, "other")]
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, shard string, ids int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in tf.op8_token_files(spark, str(tmp_path)).collect()]
    library = Tokenizer.from_file(public_tokenizers.path(tf.TOKENIZER))
    assert library.encode("a <|endoftext|> b", add_special_tokens=False).ids[2] == 50256  # an added token is found as one
    tie = lambda t: np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).astype(np.int64)
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, tie(x[1])))
    made = [(i, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows]
    want, at = [], 0
    for i, ids in made:
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_many_rows_without_id_are_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tf, "SHARD_DOCS", 20)
    rows = [(None if k % 4 else 10**15 * (k == 0) + k, f"word {k}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    files = tf.write_files(docs, into=f"{tmp_path}/files")
    of = {r.shard for r in files.where("n_null > 0").select("shard").collect()}
    assert len(of) > 3 and files.agg({"n_docs": "max"}).first()[0] < 200
    got = sorted((r.start, r.n_tokens) for r in tf.read_files(spark.read.parquet(f"{tmp_path}/files")).collect())
    assert len(got) == 400 and all(a + n == b for (a, n), (b, _) in zip(got, got[1:], strict=False))


def test_a_full_cache_changes_no_ids(monkeypatch):
    monkeypatch.setattr(tf, "CACHE", 50)
    encoder = tf.Encoder(public_tokenizers.path(tf.TOKENIZER), public_tokenizers.PATTERN)
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 9))) for _ in range(400)]
    for _ in range(30):
        texts = [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(8)]
        want = [np.array(encoder.library.encode(t, add_special_tokens=False).ids, encoder.kind).tobytes() for t in texts]
        assert encoder(texts) == want
    assert len(encoder.known) < 500 and encoder.older


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert tf.op8_token_files(spark, str(tmp_path)).count() == 0


def test_single_words_are_encoded_in_rows(monkeypatch):
    """Numbers and marks reach the library in rows, too, and have the ids that it gives them alone."""
    encoder = tf.Encoder(public_tokenizers.path(tf.TOKENIZER), public_tokenizers.PATTERN)
    texts = [f"no. {i}: {i * i}/{i + 7}% it's '{i}x中文{i}' ٣{i} {i}\x1c​{i} ...\n{i}!?" for i in range(900)]
    want = [np.array(x.ids, encoder.kind).tobytes() for x in encoder.library.encode_batch_fast(texts, add_special_tokens=False)]
    sent, plain = [], encoder._library
    monkeypatch.setattr(encoder, "_library", lambda x: sent.append(len(x)) or plain(x))
    assert encoder(texts) == want and sum(sent) < 100
    # where rows do not part, they are encoded word by word
    monkeypatch.setattr(encoder, "line", -1)
    assert encoder._words(["12", " 34", "\n"]) == {w: plain([w])[0].tobytes() for w in ("12", " 34", "\n")}
