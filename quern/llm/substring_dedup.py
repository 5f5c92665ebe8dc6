"""Substring dedup over words: seed with winnowed anchors, extend both ways, keep maximal repeats.

Every window of ``WINDOW`` words takes the least hash of the ``SEED``-word grams in it as its anchor, so equal windows
have equal anchors. Anchors that several documents share seed the search: blocks of documents learn which of their
anchors another document has. Each such anchor is extended on both sides to all windows that it is the anchor of, and
blocks learn for each window whether a document with a smaller id has it too. Such windows are covered, and those that
overlap join to maximal repeats. Of documents with equal texts only the smallest enters the second question.

Anchors are told apart by 64 bits (a false one costs time only), windows and whole texts by 96.

Cases: null or empty text has no words; rows of one doc_id never cover each other; rows with null doc_id cover nothing
and nothing covers them; repeated rows give repeated results; an empty table gives an empty result. Only doc_id and
text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import arrow, bits, cut, deal, flags_of, in_sorted, least_of, narrow, seen_twice, smaller_elsewhere, wide
from .common import bytes_of, calm, table
from .hashing import P, U, grams, hashed_words, mix, sliding_min, stretches, sums

WINDOW, SEED = 13, 5
FIRST = "block int, bucket int, keys binary, many binary, texts binary, text_checks binary, text_least binary"
FIRST_ANSWER = "block int, bucket int, shared binary, copies binary"
SECOND = "block int, bucket int, shared binary, copies binary, keys binary, checks binary, least binary"
SECOND_ANSWER = "block int, bucket int, shared binary, copies binary, covered binary"


def _check(keys: np.ndarray, prefix_hashes: np.ndarray) -> np.ndarray:
    return (mix(keys ^ (prefix_hashes * U(P))) >> U(32)).astype(np.uint32)


class _Block:
    """The words, windows and anchors of a block's texts. Everything follows from the rows' content, not their order."""

    def __init__(self, group: pa.Table, window: int, seed: int):
        self.hashes, self.before = hashed_words(*bytes_of(group.column("text").combine_chunks()))
        ids = group.column("doc_id").combine_chunks()
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        n = max(0, len(self.hashes) - window + 1)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.before))[: n + window - 1]
        self.whole = (self.doc[:n] == self.doc[window - 1 :]) & self.known[self.doc[:n]] if n else np.zeros(0, bool)
        self.anchor = sliding_min(grams(self.hashes, seed), window - seed + 1)[:n] if n else np.zeros(0, U)
        self.doc, self.window = self.doc[:n], window
        # whole texts by their words
        at, to = self.before[:-1], self.before[1:]
        prefix = sums(self.hashes)
        self.texts = stretches(prefix, at, to)
        other = stretches(sums(mix(self.hashes)), at, to)
        real = self.known & (to - at >= window)
        self.text_rows = np.flatnonzero(real)
        self.text_keys, self.text_checks, self.text_least, self.text_place = least_of(self.texts[real], _check(self.texts[real], other[real]), self.ids[real])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors in order, and whether several documents of the block have each."""
        new = self.whole.copy()
        if len(new):
            new[1:] &= (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1]) | ~self.whole[:-1]
        at = np.flatnonzero(new)
        if not len(at):
            return np.zeros(0, U), np.zeros(0, bool)
        key, ids = self.anchor[at], self.ids[self.doc[at]]
        order = np.argsort(key, kind="stable")
        edge = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        return key[order][edge], np.minimum.reduceat(ids[order], edge) < np.maximum.reduceat(ids[order], edge)

    def extended(self, answers: pa.Table, buckets: int):
        """Windows whose anchors are shared, of documents that copy no smaller one: their places, and keys, checks, least ids and places among the keys."""
        keys, _ = self.anchors()
        shared, copies = np.zeros(len(keys), bool), np.zeros(len(self.text_keys), bool)
        by, text_by = cut(keys, buckets), cut(self.text_keys, buckets)
        for k, s, c in zip(*(answers.column(x).to_pylist() for x in ("bucket", "shared", "copies")), strict=True):
            shared[by[k]] = flags_of(s, len(by[k]))
            copies[text_by[k]] = flags_of(c, len(text_by[k]))
        self.copy = np.zeros(len(self.ids), bool)
        self.copy[self.text_rows] = copies[self.text_place] | (self.ids[self.text_rows] > self.text_least[self.text_place])
        at = np.flatnonzero(self.whole & ~self.copy[self.doc] & in_sorted(self.anchor, keys[shared]))
        content = stretches(sums(self.hashes), at, at + self.window)
        other = stretches(sums(mix(self.hashes)), at, at + self.window)
        return at, *least_of(content, _check(content, other), self.ids[self.doc[at]])


def remove_repeats(df: DataFrame, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the text without words that windows of smaller documents cover, joined by one space."""
    kind = df.schema["doc_id"].dataType.simpleString()
    dealt, buckets = deal(df)

    @calm
    def first(group: pa.Table) -> pa.Table:
        block = _Block(group, window, seed)
        keys, many = block.anchors()
        rows = []
        for k, (a, t) in enumerate(zip(cut(keys, buckets), cut(block.text_keys, buckets), strict=True)):
            if len(a) or len(t):
                rows.append((k, keys[a].tobytes(), bits(many[a]), block.text_keys[t].tobytes(), block.text_checks[t].tobytes(), narrow(block.text_least[t])))
        number = group.column("block")[0].as_py()
        return arrow([(number, *r) for r in rows], FIRST)

    @calm
    def first_answer(rows: pa.Table) -> pa.Table:
        x = rows.to_pylist()
        keys = [np.frombuffer(r["keys"], U) for r in x]
        shared = seen_twice(keys, [flags_of(r["many"], len(k)) for r, k in zip(x, keys, strict=True)])
        copies = smaller_elsewhere([np.frombuffer(r["texts"], U) for r in x], [np.frombuffer(r["text_checks"], np.uint32) for r in x], [wide(r["text_least"]) for r in x])
        return arrow([(r["block"], r["bucket"], s, c) for r, s, c in zip(x, shared, copies, strict=True)], FIRST_ANSWER)

    @calm
    def second(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return arrow([], SECOND)
        _, keys, checks, least, _ = _Block(group, window, seed).extended(answers, buckets)
        by = cut(keys, buckets)
        known = {r["bucket"]: (r["shared"], r["copies"]) for r in answers.to_pylist()}
        number = group.column("block")[0].as_py()
        rows = [(number, k, *known.get(k, (b"", b"")), keys[p].tobytes(), checks[p].tobytes(), narrow(least[p])) for k, p in enumerate(by) if len(p) or k in known]
        return arrow(rows, SECOND)

    @calm
    def second_answer(rows: pa.Table) -> pa.Table:
        x = rows.to_pylist()
        covered = smaller_elsewhere([np.frombuffer(r["keys"], U) for r in x], [np.frombuffer(r["checks"], np.uint32) for r in x], [wide(r["least"]) for r in x])
        return arrow([(r["block"], r["bucket"], r["shared"], r["copies"], c) for r, c in zip(x, covered, strict=True)], SECOND_ANSWER)

    @calm
    def last(group: pa.Table, answers: pa.Table) -> pa.Table:
        block = _Block(group, window, seed)
        at, keys, _, least, place = block.extended(answers, buckets)
        elsewhere = np.zeros(len(keys), bool)
        by = cut(keys, buckets)
        for k, c in zip(answers.column("bucket").to_pylist(), answers.column("covered").to_pylist(), strict=True):
            elsewhere[by[k]] = flags_of(c, len(by[k]))
        hit = at[elsewhere[place] | (block.ids[block.doc[at]] > least[place])]
        step = np.zeros(len(block.hashes) + window + 1, np.int32)
        step[hit] += 1
        step[hit + window] -= 1
        keep = np.cumsum(step[: len(block.hashes)]) == 0
        counts, removed, texts = [], [], []
        for k, text in enumerate(group.column("text").to_pylist()):
            words = text.encode().split()
            own = keep[block.before[k] : block.before[k + 1]]
            kept = [] if block.copy[k] else words if own.all() else [words[j] for j in np.flatnonzero(own)]
            counts.append(len(words))
            removed.append(len(words) - len(kept))
            texts.append(b" ".join(kept).decode())
        return pa.table({"doc_id": group.column("doc_id"), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(texts, pa.string())})

    asked = dealt.groupBy("block").applyInArrow(first, FIRST).groupBy("bucket").applyInArrow(first_answer, FIRST_ANSWER)
    again = dealt.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(second, SECOND).groupBy("bucket").applyInArrow(second_answer, SECOND_ANSWER)
    return dealt.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(last, f"doc_id {kind}, n_words bigint, n_removed bigint, kept string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, those removed, and the digest of the kept ones."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS gram FROM s),
m AS (SELECT gram, min(doc_id) AS least FROM g GROUP BY gram),
c AS (SELECT DISTINCT doc_id, i + unnest(range(0, 13)) AS pos FROM g JOIN m USING (gram) WHERE least < doc_id),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
k AS (SELECT p.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY pos) AS kept FROM p ANTI JOIN c USING (doc_id, pos) GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""


def brute_force(rows: list[tuple[int, str]], window: int = WINDOW) -> list[tuple[int, int, int, str]]:
    """The same result by its definition, for tests."""
    words = [(i, (t or "").encode().split()) for i, t in rows]
    least: dict[tuple, int] = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                least[key] = min(i, least.get(key, i))
    out = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - window + 1) if i is not None and least[tuple(w[k : k + window])] < i for j in range(window)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out
