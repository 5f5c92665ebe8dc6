import hashlib
import random
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import blocks
from quern.llm import suffix_dedup as sd


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=90), min_size=1, max_size=6), st.integers(7, 30))
def test_interval_expansion(texts, length):
    parts = [t.encode() for t in texts if len(t) >= length]
    if parts:
        times = Counter(t[k : k + length] for t in parts for k in range(len(t) - length + 1))
        want = [[times[t[k : k + length]] > 1 for k in range(len(t) - length + 1)] for t in parts]
        assert [x.tolist() for x in sd.repeated_windows(parts, length)] == want


def test_interval_expansion_on_large_symbols():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, 3000, dtype=np.uint8).tobytes()
    parts = [base, base[500:1500] + b"x" + base[2000:], bytes(2000), b"\xff" * 900, base[:450]]
    times = Counter(t[k : k + 400] for t in parts for k in range(len(t) - 399))
    assert [x.tolist() for x in sd.repeated_windows(parts, 400)] == [[times[t[k : k + 400]] > 1 for k in range(len(t) - 399)] for t in parts]


def make_rows():
    rng = random.Random(7)
    vocab = ["".join(rng.choices("abcdefghij é", k=rng.randint(2, 9))) for _ in range(300)]
    text = lambda n: " ".join(rng.choices(vocab, k=n))
    shared = [text(rng.choice([50, 80, 150, 400])) for _ in range(8)]
    rows = [(None, None), (1, ""), (2, "x" * 399), (3, "y" * 400), (4, "y" * 401), (5, "ab" * 700), (6, shared[0]), (6, shared[0]), (None, shared[1])]
    for i in range(10, 120):
        rows.append((i, " ".join(rng.choice(shared) if rng.random() < 0.3 else text(rng.randint(5, 90)) for _ in range(rng.randint(1, 4)))))
    return rows + [(i + 300, t[:-3] + "?" + t[-2:]) for i, t in rows[20:40]] + [(i + 600, t) for i, t in rows[30:50]]


def outcome(spark, rows, limits):
    """The query's columns with other limits: tasks would not see limits that a test sets in this process alone."""
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sd.remove_repeats(df, limits=limits)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in out.collect()), key=str)


def run(spark, tmp_path, rows):
    spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, kept string, block int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r)[:5] for r in sd.op1_suffix_dedup(spark, str(tmp_path)).collect()), key=str)


def test_against_brute_force(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 9_000)
    monkeypatch.setattr(blocks, "BUCKET_BYTES", 30_000)
    assert run(spark, tmp_path, make_rows()) == sorted(sd.brute_force(make_rows()), key=str)


def test_across_slices_and_cut_segments(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 20_000)
    got = outcome(spark, make_rows(), sd.Limits(slice=700, longest=90, batch=5_000))
    assert got == sorted(sd.brute_force(make_rows()), key=str)


def with_a_line(n):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    line, long = text(40)[:200], text(90)[:440]
    rows = [(i, f"{text(60)} {line} {text(60)}") for i in range(n)] + [(n + i, f"{text(50)} {long}{text(50)}") for i in range(n // 4)]
    return rows + [(2 * n + i, rows[i][1]) for i in range(0, n, 9)]


def test_one_line_in_all_documents(spark, tmp_path, monkeypatch):
    """Its keys are hot: their windows are dealt by their own hashes."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(blocks, "BUCKET_BYTES", 40_000)
    rows = with_a_line(160)
    want = sorted(sd.brute_force(rows), key=str)
    for limits in (sd.Limits(hot=20, hot_here=5), sd.Limits(hot=0), sd.Limits(hot_here=0, slice=900), sd.Limits()):
        assert outcome(spark, rows, limits) == want


def test_no_bucket_gets_a_hot_key():
    """Of a key that many documents have, a block sends one entry, and no bytes are asked for."""
    texts = [t.encode() for _, t in with_a_line(160)[:200]]
    ends = np.cumsum([len(t) for t in texts])
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.append(0, ends)
    own = sd.Entries(data, offsets, sd.LENGTH, sd.SEED, sd.Limits(hot_here=5))
    most = Counter(own.keys.tolist()).most_common(1)[0][1]
    assert most <= 5 and (own.flags >= 4).any()
    row = {"block": 0, "bucket": 0, "entries": np.arange(len(own.keys), dtype=np.int32).tobytes(), "keys": own.keys.tobytes(), "contents": own.contents.tobytes(), "flags": own.flags.tobytes()}
    said = sd.judged([row, {**row, "block": 1}], 2048)
    sent = [np.frombuffer(r[5], np.uint8) for r in said]
    assert sum((x == sd.SPLIT).sum() for x in sent) == 2 * (own.flags >= 4).sum()
    assert sum(((x == sd.SEND) | (x == sd.SEND_WHOLE)).sum() for x in sent) <= len(own.keys)


def shared_by_definition(rows, seed, each):
    texts = [(i, (t or "").encode()) for i, t in rows]
    power = [pow(sd.P, j, 1 << 64) for j in range(seed)]
    value = lambda x: sum(int(sd.BYTE[c]) * p for c, p in zip(x, power, strict=True)) % (1 << 64)
    places = [(n, k, t[k : k + seed]) for n, (_, t) in enumerate(texts) for k in range(len(t) - seed + 1)]
    known = {x: value(x) for _, _, x in places}
    anchors = [(n, k, x) for n, k, x in places if (known[x] >> 33) % each == 0]
    times = Counter(x for _, _, x in anchors)
    covered = [set() for _ in texts]
    for n, k, x in anchors:
        if times[x] > 1:
            covered[n].update(range(k, k + seed))
    return sorted(((i, len(t), len(c)) for (i, t), c in zip(texts, covered, strict=True)), key=str)


def test_shared_anchors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 6_000)
    rows = make_rows()[:60] + [(900, "z" * 130), (901, "z" * 127), (902, "only " * 30), (903, "q" + "only " * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, r.n_shared) for r in sd.remove_repeats(df, limits=sd.Limits(slice=500, each=5)).collect()), key=str)
    want = shared_by_definition(rows, sd.SEED, 5)
    assert got == want and sum(x[2] > 0 for x in want) > 10


def test_no_rows(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_rows_of_a_block_in_any_order(spark, monkeypatch):
    """Executors that fetch from one another get a block's rows in another order for each pass."""
    calm, passes = sd.calm, []

    def shuffled(f):
        passes.append(n := len(passes))
        stirred = lambda t: t.take(np.random.default_rng(n).permutation(t.num_rows)) if "text" in t.column_names else t
        return calm((lambda one: f(stirred(one))) if f.__code__.co_argcount == 1 else (lambda one, other: f(stirred(one), other)))

    monkeypatch.setattr(sd, "calm", shuffled)
    rows = make_rows()
    assert outcome(spark, rows, sd.Limits()) == sorted(sd.brute_force(rows), key=str) and len(passes) == 5
