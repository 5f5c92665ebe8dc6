import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from quern.llm import decontaminate as dc


def terms(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items):
    """Every passage against every item, without index or bounds."""
    parts = []
    for i, q, a in items:
        q, a = terms(q), None if a is None else terms(a)
        if a is None:
            cut = len(q) - len(q) // 4
            q, a = q[:cut], q[cut:]
        parts.append((i, q, a))
    df = Counter(t for _, q, a in parts for t in set(q + a))
    mean = sum(len(q) + len(a) for _, q, a in parts) / max(len(parts), 1) or 1.0
    idf = {t: math.log(1 + (len(parts) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    stride = max([dc.STRIDE, *(len(q) + len(a) for _, q, a in parts)])

    def grams(x, n):
        return {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()

    out = []
    for d, text in docs:
        words, hits = terms(text), {}
        for start in range(0, max(len(words), 1), stride):
            passage = words[start : start + 2 * stride]
            for k, (i, q, a) in enumerate(parts):
                tf = Counter(q + a)
                weight = {t: idf[t] * n * (dc.K1 + 1) / (n + dc.K1 * (1 - dc.B + dc.B * (len(q) + len(a)) / mean)) for t, n in tf.items()}
                score = sum(w for t, w in weight.items() if t in set(passage))
                if tf and score >= dc.THRESHOLD * sum(weight.values()) - 1e-9:
                    if all(len(grams(x, n) & grams(passage, n)) >= dc.OVERLAP * len(grams(x, n)) for x in (q, a) for n in [min(dc.GRAM, len(x))]):
                        hits[k] = max(hits.get(k, 0), score / sum(weight.values()))
        out.append((d, len(hits), ",".join(map(str, sorted({parts[k][0] for k in hits}))), round(max(hits.values(), default=0.0), 5)))
    return out


def make_rows():
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdehilnorstué", k=rng.randint(1, 6))) for _ in range(250)]
    text = lambda n: " ".join(rng.choices(vocab, k=n)).capitalize() + "."
    items = [(i, text(rng.randint(15, 70)), text(5) if i % 3 else None) for i in range(40)] + [(40, "", None), (41, None, None), (42, "one", None), (43, "What is it?", "")]
    items.append((44, items[3][1], items[3][2]))
    docs = [(None, items[1][1] + " " + (items[1][2] or "")), (1, None), (2, ""), (3, text(3000)), (4, "One"), (5, items[5][1])]
    for d in range(10, 80):
        i, q, a = rng.choice(items[:40])
        words = f"{q} {a or ''}".split()
        for _ in range(rng.choice([0, 0, 2, 8, 20])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        docs.append((d, f"{text(rng.randint(0, 200))} {' '.join(words)}\n{text(rng.randint(0, 200))}"))
    return docs + docs[8:11], items


def run(spark, tmp_path, docs, items):
    spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, hits string, question string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = dc.contaminated(spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text"), spark.createDataFrame(items, "item_id long, question string, answer string"))
    out = []
    for r in found.collect():
        out.append((r.doc_id, len(r.hits), ",".join(map(str, sorted({h.item_id for h in r.hits}))), round(max((h.score for h in r.hits), default=0.0) * dc.THRESHOLD, 5)))
    return sorted(out, key=str)


def test_against_brute_force(spark, tmp_path):
    docs, items = make_rows()
    want = sorted(brute_force(docs, items), key=str)
    assert sum(n for _, n, _, _ in want) > 20
    assert run(spark, tmp_path, docs, items) == want


def test_several_indexes(spark, tmp_path, monkeypatch):
    docs, items = make_rows()
    monkeypatch.setattr(dc, "MOST_ITEMS", 15)
    assert run(spark, tmp_path, docs[:40], items) == sorted(brute_force(docs[:40], items), key=str)


def test_no_items_and_no_rows(spark, tmp_path):
    assert run(spark, tmp_path, [(1, "a b c")], []) == [(1, 0, "", 0.0)]
    (tmp_path / "b").mkdir()
    assert run(spark, tmp_path / "b", [], [(1, "a b", None)]) == []


def test_edited_and_shortened_copies_of_items_without_answer(spark, tmp_path):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(n)), None) for i, n in enumerate([38, 16, 59])]
    pair = [f"p{k}" for k in range(38)]
    items.append((3, " ".join(pair[:29]), " ".join(pair[29:])))
    docs, want = [], {}

    def add(words, edited, *hits):
        docs.append((len(docs), " ".join(["before", *("changed" if k in edited else w for k, w in enumerate(words)), "after"])))
        want[docs[-1][0]] = list(hits)

    for i, q, _ in items[:3]:
        words = q.split()
        n = len(words)
        for k in range(n):
            add(words, {k}, i)
        for a, b in [(n - 4, n - 5), (n - 2, n - 4), (0, n - 1), (1, n - 3)]:
            add(words, {a, b}, i)
        add(words[: n - n // 4], (), i)
        add(words[n // 4 :], (), i)
        add(words[: n // 2], ())
    add(pair, (), 3)
    add(pair, {10}, 3)
    add(pair, {33})  # a real answer must be there by itself
    add(pair[:29], ())
    spark.createDataFrame(docs, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    found = dc.contaminated(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.createDataFrame(items, "item_id long, question string, answer string"))
    assert {r.doc_id: [h.item_id for h in r.hits] for r in found.collect()} == want


def test_pivots_retrieve_what_plain_scoring_does():
    """Over all blocks: the items of score 1 and over, whatever is skipped."""
    rng = np.random.default_rng(5)
    items = [(k, rng.integers(0, 60, rng.integers(3, 30)).astype(np.uint64), np.zeros(0, np.uint64)) for k in range(70)]
    df = Counter(t for _, q, _ in items for t in set(q.tolist()))
    idf = {t: math.log(1 + (len(items) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    index = dc.Index(items, idf, 15.0, 30)
    plain = defaultdict(dict)
    for place, item, weight in zip(index.place.tolist(), index.item.tolist(), index.weight.tolist(), strict=True):
        plain[place // index.blocks][item] = weight
    some = 0
    for _ in range(200):
        terms = np.unique(index.numbers(rng.integers(0, 70, rng.integers(1, 40)).astype(np.uint64)))
        scores = Counter()
        for t in terms.tolist():
            for k, w in plain[t].items():
                scores[k] += w
        want = {k: round(s, 9) for k, s in scores.items() if s >= 1 - 1e-9}
        got = [x for b in range(index.blocks) for x in index.retrieved(terms, b, index.maxima(terms, b))]
        assert {k: round(s, 9) for k, s in got} == want and len(got) == len(want)
        some += len(want)
    assert some > 50


def test_essential_postings_lead_to_all_that_plain_scoring_finds(monkeypatch):
    """Whatever is read at once: (passage, block) of every item that a passage scores at 1 or more."""
    rng = np.random.default_rng(7)
    items = [(k, np.minimum(rng.zipf(1.3, rng.integers(1, 40)), 300).astype(np.uint64), np.zeros(0, np.uint64)) for k in range(90)]
    df = Counter(t for _, q, _ in items for t in set(q.tolist()))
    idf = {t: math.log(1 + (len(items) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    index = dc.Index(items, idf, 20.0, 40)
    assert len(index.lead_item) < 0.8 * len(index.item)
    weight = defaultdict(dict)
    for place, item, w in zip(index.place.tolist(), index.item.tolist(), index.weight.tolist(), strict=True):
        weight[item][place // index.blocks] = w
    pieces = [np.minimum(rng.zipf(1.3, 60), 320).astype(np.uint64) for _ in range(120)]
    for k in range(0, 120, 3):  # an item across two pieces
        q = items[k % 90][1]
        pieces[k], pieces[k + 1] = np.append(pieces[k], q[: len(q) // 2]), np.append(q[len(q) // 2 :], pieces[k + 1])
    owner = np.sort(rng.integers(0, 25, 120))
    pairs = sorted({(p, t) for p, x in enumerate(pieces) for t in index.numbers(x).tolist() if t < len(index.terms)})
    at, term = (np.array(x) for x in zip(*pairs, strict=True))
    want = set()
    for p in range(120):
        own = {t for q, t in pairs if q == p or q == p + 1 < 120 and owner[q] == owner[p]}
        want |= {(p, k // dc.BLOCK) for k, by in weight.items() if sum(w for t, w in by.items() if t in own) >= 1}
    assert len(want) > 60
    for size in (1, 700, 1 << 21):
        monkeypatch.setattr(dc, "AT_ONCE", size)
        got = [tuple(x) for x in index._candidates(at, term, owner).tolist()]
        assert len(got) == len(set(got)) and want <= set(got)


def test_items_beyond_the_bound_of_characters(spark, monkeypatch):
    """One index at a time, with the hits of the last one in a table."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(400)}" for _ in range(30)) for _ in range(12)]
    items = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], "item_id long, question string, answer string")
    docs = spark.createDataFrame([(k, f"before it {t} and after") for k, t in enumerate(texts)] + [(99, "none of them")], "doc_id long, text string")
    want = {r.doc_id: [h.item_id for h in r.hits] for r in dc.contaminated(docs, items).collect()}
    assert want == {**{k: [k] for k in range(12)}, 99: []}
    monkeypatch.setattr(dc, "MOST_CHARS", 500)
    assert dc.parts_of(items) > 3
    assert {r.doc_id: [h.item_id for h in r.hits] for r in dc.contaminated(docs, items).collect()} == want
