import hashlib
import math
import random
import re
import struct
from collections import Counter

import xxhash

from quern.llm import imatch


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fingerprint string, row int").repartition(3)
    return imatch.fingerprints(df).collect()


def make_rows(n=300):
    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdefghiklmnoprstuéä汉", k=rng.randint(2, 8))) for _ in range(6000)]
    rows = [(7 * k + 3, " ".join(rng.choices(vocab, k=rng.randint(30, 200)))) for k in range(n)]
    return [*rows, (5000, None), (5001, ""), (None, "null id"), (10, rows[5][1]), (10, "same id"), (9000, rows[7][1]), (9999, "w " * 20_000), (-50, "A b.c D")]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def text_hash(text, seed=42):
    return xxhash.xxh64_intdigest(text.encode(), seed)


def list_hash(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return h


def terms_of(text):
    return {signed(text_hash(t)) for t in re.split(imatch.SEPARATORS, text.lower(), flags=re.ASCII) if t}


def depth(term, seed):
    h = xxhash.xxh64_intdigest(struct.pack("<i", seed), xxhash.xxh64_intdigest(struct.pack("<q", term), 42))
    return min(imatch.TOP + 1, 64 if not h else (h & -h).bit_length() - 1)


def brute_force(texts):
    """(fingerprint as level and hashes, text) by plain Python from the definition."""
    n = len(texts)
    counts = Counter(t for text in texts for t in terms_of(text))
    low, high = max(imatch.LEAST_DOCS, math.ceil(imatch.LEAST_SHARE * n)), max(imatch.LEAST_DOCS, math.floor(imatch.MOST_SHARE * n))
    band = {t for t, k in counts.items() if low <= k <= high}

    def fingerprint(text):
        own = sorted(terms_of(text) & band)
        drawn = {t: [depth(t, s) for s in range(imatch.SEEDS)] for t in own}
        if not own:
            own = [signed(text_hash(text))]
            drawn = {own[0]: [15] * imatch.SEEDS}
        level = max(0, min(imatch.TOP - imatch.LEVELS + 1, math.ceil(math.log2(len(own))) - imatch.LEVELS + 1))
        hashes = []
        for at in range(level, level + imatch.LEVELS):
            left = [[t for t in own if drawn[t][s] >= at] for s in range(imatch.SEEDS)]
            hashes.append([list_hash(x) if x else 0 for x in left])
        return level, hashes

    return fingerprint


def told(p):
    return f"{p[0]}:" + ":".join(".".join(f"{h & 0xFFFFFFFF:08x}" if h else "-" for h in hs) for hs in p[1])


def likeness(p, q):
    lists = {k: dict(enumerate(x[1], x[0])) for k, x in (("p", p), ("q", q))}
    pairs = [(a, b) for at in lists["p"].keys() & lists["q"].keys() for a, b in zip(lists["p"][at], lists["q"][at], strict=True) if a or b]
    return sum(a == b for a, b in pairs) / len(pairs) if pairs else 0.0


def in_order(rows):
    return sorted(((i, t or "") for i, t in rows), key=lambda x: (x[0] is not None, x[0] or 0, signed(text_hash(x[1])), x[1]))


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE", 16)
    rng = random.Random(4)
    common = [f"c{k}" for k in range(400)]
    rows = [(i, t if t is None or i is None else f"{t} {' '.join(rng.choices(common, k=rng.randint(0, 60)))}") for i, t in make_rows(200)]
    got = run(spark, rows)
    texts = [t for _, t in in_order(rows)]
    of = brute_force(texts)
    want = []
    for k, (i, t) in enumerate(in_order(rows)):
        nxt, half = texts[(k + 1) % len(texts)], len(t) // 2
        p, q, r = of(t), of(t[: len(t) - half] + nxt[:half]), of(nxt)
        want.append((i, len(t), told(p), told(q), round(likeness(p, q), 9), round(likeness(p, r), 9)))
    found = [(r.doc_id, r.n_chars, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert sum(0 < x[4] < 1 for x in want) > 50


def test_a_far_id_one_id_and_no_id_fill_no_range(spark, monkeypatch):
    """Ranges hold few rows each, and ascend with the order of the documents."""
    monkeypatch.setattr(imatch, "RANGE", 10)
    rows = [(k, f"t{k}") for k in range(300)] + [(10**15, "far")] + [(7, f"same {k}") for k in range(300)] + [(None, f"none {k}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ranged = imatch.ranged(df, 901, 300).collect()
    assert max(Counter(r.range for r in ranged).values()) < 60
    order = [r.range for r in sorted(ranged, key=lambda r: (r.doc_id is not None, r.doc_id or 0, signed(text_hash(r.text))))]
    assert order == sorted(order)


def test_a_large_lexicon_is_not_broadcast(spark, monkeypatch):
    rows = make_rows(60)
    want = sorted(map(tuple, run(spark, rows)), key=str)
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", 0)
    assert sorted(map(tuple, run(spark, rows)), key=str) == want


def test_columns_by_definition(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE", 16)
    rows = make_rows()
    got = run(spark, rows)
    texts = in_order(rows)
    want = []
    for k, (i, t) in enumerate(texts):
        nxt, half = texts[(k + 1) % len(texts)][1], len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    by_text = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    for i, t in texts:
        by_text.setdefault(t, set()).update(r.fingerprint for r in got if r.doc_id == i and r.n_chars == len(t))
    assert all(len(x) == 1 for t, x in by_text.items())
    real = [r for r in got if r.n_chars > 100]
    assert sum(r.near_edited for r in real) / len(real) > 0.1 > 5 * sum(r.near_next for r in real) / len(real)
    assert all((r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint) for r in got)


def test_one_row_and_none(spark):
    one = run(spark, [(4, "a b c d")])
    assert len(one) == 1 and one[0].near_next == 1.0
    assert run(spark, []) == []


def test_texts_are_shuffled_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE", 10)
    spark.createDataFrame(make_rows(120), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = imatch.fingerprints(spark.read.parquet(f"{tmp_path}/d"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert re.search(r"ReusedExchange \[range#[0-9]+L, doc_id#[0-9]+L, text#", text)


def test_plan_has_no_python(spark, capsys):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    imatch.fingerprints(df).explain()
    assert not any(x in capsys.readouterr().out for x in ("Python", "Pandas", "Arrow"))
