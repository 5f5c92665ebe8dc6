import random

from quern.llm import blocks
from quern.llm import substring_dedup as sd

SCHEMA = "doc_id long, text string, anchor string, place string"


def run(spark, tmp_path, rows):
    spark.createDataFrame([(i, t, "a", "b") for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in sd.op6_substring_dedup(spark, str(tmp_path)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    return sorted(got, key=str)


def test_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 12_000)
    monkeypatch.setattr(blocks, "BUCKET_BYTES", 20_000)
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(40)] + ["ä", "the"]
    passages = [" ".join(rng.choices(vocab, k=rng.randint(8, 40))) for _ in range(12)]
    rows = [(None, passages[0]), (3, None), (4, ""), (5, " \n\t "), (7, "x " * 600), (8, "x " * 500), (9, passages[1]), (9, passages[1]), (9, passages[2] + " y"), (12, passages[1])]
    for i in range(20, 220):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choices(vocab, k=20)) for _ in range(rng.randint(1, 5))]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    rows += [(i + 500, t) for i, t in rows[30:60]]
    assert run(spark, tmp_path, rows) == sorted(sd.brute_force(rows), key=str)


def test_no_rows(spark, tmp_path):
    assert run(spark, tmp_path, []) == []
