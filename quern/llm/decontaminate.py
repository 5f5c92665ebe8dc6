"""Benchmark decontamination: every training passage is a query against a BM25 index of the test items.

The index has for each term the BM25 weight of each item that holds it, divided by ``THRESHOLD`` times the item's score
for its own text, so that an item is retrieved at 1. Items lie in blocks by length; for each term and block that have
postings it also has their greatest weight. A text is cut into passages of 2 * ``STRIDE`` terms every ``STRIDE`` terms,
or as many as the longest item has.

Search is block-max WAND over many passages at once. An item's essential postings are those of its rarest terms, so many
that its other terms together stay ``SLACK`` below 1: a passage retrieves the item only where its essential postings
bring what the others cannot. Only essential postings are read for all passages; the postings of frequent terms, most of
all, are skipped but for the blocks that they lead to. A passage looks up the maxima of such a block, skips the block if
their sum stays below 1, and else moves cursors of its terms to pivots: the first item at which the maxima of the terms
that can still hold it reach 1. Cursors skip what lies before the pivot, and only items that all of these cursors have
reached are scored.

Retrieved items are verified: the passage must hold at least ``OVERLAP`` of the ``GRAM``-term grams of the item's
question and of its answer. Items without an answer are one part: ``OVERLAP`` of all their grams is enough, wherever
the others were lost. Terms are lower-case (A-Z) runs of letters, digits and bytes beyond ASCII; terms and grams are told
apart by 64 bits.

The index goes to every task, so its size is bounded: benchmarks beyond ``MOST_ITEMS`` items or ``MOST_CHARS`` characters
are cut into several indexes. They are made, sent and used one after the other, a pass over the documents each, with
the hits so far in a written table between; term statistics are those of all items, and only these (a number for each
distinct term of the benchmark) stay on the driver. Documents are not shuffled.

Cases: null or empty texts have no passages and no hits; empty items are never retrieved; repeated items count as items
of their own; repeated documents give repeated results; without items nothing is contaminated. The output column must
have a name that the documents lack.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, dropped, prepare, table, written
from .hashing import APART, U, grams, hashed_words, inside_runs

K1, B = 0.9, 0.4
THRESHOLD, STRIDE, BLOCK, SLACK, GRAM, OVERLAP = 0.6, 64, 8, 0.3, 3, 0.6
MOST_ITEMS, MOST_CHARS = 20_000, 16_000_000
#: Essential postings that are read at once, and the bits and the unit of their weights, which are rounded up.
AT_ONCE, BITS, UNIT = 1 << 21, 16, 1 << 12


def terms_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return hashed_words(*bytes_of(pa.array(texts, pa.string())), lower=True, apart=APART)


class Index:
    """Weights of terms for items, by term and then item, and the greatest of each block of items."""

    def __init__(self, items: list[tuple[int, np.ndarray, np.ndarray]], idf: dict[int, float], mean: float, longest: int):
        """Items as (id, terms of the question, terms of the answer); ``longest`` counts the terms of the longest item of all indexes."""
        items = sorted((x for x in items if len(x[1]) + len(x[2])), key=lambda x: (len(x[1]) + len(x[2]), x[0]))
        self.ids = [x[0] for x in items]
        self.parts = [tuple(self._grams(p) for p in x[1:]) for x in items]
        self.lengths = [(len(x[1]), len(x[2])) for x in items]
        self.stride = max(STRIDE, longest)
        terms, owners, weights, leads = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, bool)]
        #: What the essential postings of each item must bring, in units.
        self.least = np.zeros(len(items), np.int64)
        for k, (_, q, a) in enumerate(items):
            own, n = np.unique(np.concatenate([q, a]), return_counts=True)
            norm = K1 * (1 - B + B * (len(q) + len(a)) / mean)
            rare = np.array([idf[t] for t in own.tolist()])
            weight = rare * n * (K1 + 1) / (n + norm)
            weight /= THRESHOLD * weight.sum()
            order = np.argsort(-rare, kind="stable")
            rest = 1 / THRESHOLD - np.cumsum(weight[order])
            most = min(int(np.searchsorted(-rest, SLACK - 1, side="right")), len(own) - 1)
            lead = np.zeros(len(own), bool)
            lead[order[: most + 1]] = True
            self.least[k] = math.floor((1 - 1e-6 - max(rest[most], 0.0)) * UNIT)
            terms.append(own)
            owners.append(np.full(len(own), k))
            weights.append(weight)
            leads.append(lead)
        self.terms, number = np.unique(np.concatenate(terms), return_inverse=True)
        item = np.concatenate(owners)
        order = np.lexsort((item, number))
        self.item, self.weight = item[order].astype(np.int32), np.concatenate(weights)[order]
        self.blocks = max(1, -(-len(items) // BLOCK))
        #: Term and block of each posting, in order; and of the maxima, likewise.
        self.place = number[order].astype(np.int64) * self.blocks + self.item // BLOCK
        edge = np.flatnonzero(np.append(True, self.place[1:] != self.place[:-1])[: len(self.place)])
        self.most_place = self.place[edge]
        self.most = np.maximum.reduceat(self.weight, edge).astype(np.float32) if len(edge) else np.zeros(0, np.float32)
        #: The essential postings: item and weight, and where each term's begin.
        lead = np.flatnonzero(np.concatenate(leads)[order])
        self.lead_item, self.lead_weight = self.item[lead].astype(U), np.ceil(self.weight[lead] * UNIT).astype(U)
        self.lead_first = np.searchsorted(number[order][lead], np.arange(len(self.terms) + 1))

    def maxima(self, terms: np.ndarray, block: int) -> np.ndarray:
        """The greatest weight of each term in a block, 0 where it has none there."""
        place = terms * self.blocks + block
        at = np.minimum(np.searchsorted(self.most_place, place), max(len(self.most_place) - 1, 0))
        return np.where(self.most_place[at] == place, self.most[at], np.float32(0)) if len(self.most_place) else np.zeros(len(terms), np.float32)

    @staticmethod
    def _grams(terms: np.ndarray) -> frozenset[int]:
        n = min(GRAM, len(terms))
        return frozenset(grams(terms, n).tolist() if n else ())

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Each hash's place among the terms; the last place for others."""
        at = np.searchsorted(self.terms, hashes)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == hashes, at, len(self.terms)) if len(self.terms) else np.zeros(len(hashes), np.int64)

    def search(self, hashes: np.ndarray, before: np.ndarray) -> list[dict[int, float]]:
        """For each text the verified items and their best scores."""
        stride = self.stride
        n = np.diff(before)
        pieces = np.maximum(1, -(-n // stride))  # strides of each text; a passage is one and the next
        first = np.cumsum(pieces) - pieces
        doc = np.repeat(np.arange(len(n)), n)
        piece = first[doc] + (np.arange(len(hashes)) - before[:-1][doc]) // stride
        term = self.numbers(hashes)
        width = len(self.terms) + 1
        pairs = np.unique((piece * width + term)[term < width - 1])
        at, term = pairs // width, pairs % width
        found: list[dict[int, float]] = [{} for _ in n]
        if not len(at):
            return found
        owner = np.repeat(np.arange(len(n)), pieces)
        for p, block in self._candidates(at, term, owner).tolist():
            self._verified(p, block, at, term, owner, first, before, hashes, stride, found)
        return found

    def _candidates(self, at: np.ndarray, term: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """(passage, block) with an item whose essential postings bring enough; a passage is a piece and its text's next.

        ``at`` and ``term`` are the distinct terms of each piece, in order. A term in both pieces counts twice: a bound.
        """
        size = np.diff(self.lead_first)[term]
        load = np.append(0, np.cumsum(np.bincount(at, weights=size, minlength=len(owner)).astype(np.int64)))
        items, out, a = max(len(self.least), 1), [np.zeros((0, 2), np.int64)], 0
        while a < len(owner):
            b = max(a + 1, int(np.searchsorted(load, load[a] + AT_ONCE, side="right")) - 1)
            lo, hi = np.searchsorted(at, [a, b + 1])  # the piece after the last one ends its passage
            run, place = inside_runs(size[lo:hi])
            place += self.lead_first[term[lo:hi]][run]
            key = (at[lo:hi][run] - a).astype(U) * U(items) + self.lead_item[place]
            packed = np.sort(key << U(BITS) | self.lead_weight[place])
            key = (packed >> U(BITS)).astype(np.int64)
            edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
            if len(edge):
                key, brings = key[edge], np.add.reduceat((packed & U((1 << BITS) - 1)).astype(np.int64), edge)
                piece, item = key // items, key % items
                follows = np.append(owner[1:] == owner[:-1], False)
                after = np.minimum(np.searchsorted(key, key + items), len(key) - 1)
                both = brings + np.where(follows[piece + a] & (key[after] == key + items), brings[after], 0)
                # passages that begin at the piece, and those that begin one before and have only this piece's postings
                own = (both >= self.least[item]) & (piece < b - a)
                last = (brings >= self.least[item]) & (piece > 0) & follows[piece + a - 1]
                found = np.concatenate([piece[own], piece[last] - 1]) + a
                out.append(np.unique(np.stack([found, np.concatenate([item[own], item[last]]) // BLOCK], 1), axis=0))
            a = b
        return np.concatenate(out)

    def retrieved(self, terms: np.ndarray, block: int, most: np.ndarray) -> list[tuple[int, float]]:
        """The items of a block that these distinct terms, with their maxima there, score at 1 or more, by pivots."""
        here = most > 0
        terms, most = terms[here], most[here]
        if most.sum() < 1 - 1e-4:
            return []
        place = terms * self.blocks + block
        lo, hi = self.place.searchsorted(place, "left"), self.place.searchsorted(place, "right")
        # cursors (item, place in the postings, end, greatest weight), those at the least item first
        cursors = [list(x) for x in zip(self.item[lo].tolist(), lo.tolist(), hi.tolist(), most.tolist(), strict=True)]
        out = []
        while cursors:
            cursors.sort()
            reach, pivot = 0.0, None
            for c in cursors:
                reach += c[3]
                if reach >= 1 - 1e-4:  # maxima have 32 bits
                    pivot = c[0]
                    break
            if pivot is None:
                break
            if cursors[0][0] == pivot:
                score = sum(float(self.weight[c[1]]) for c in cursors if c[0] == pivot)
                if score >= 1 - 1e-9:
                    out.append((pivot, score))
                ahead = pivot + 1
            else:
                ahead = pivot
            for c in cursors:
                if c[0] < ahead:
                    c[1] += int(self.item[c[1] : c[2]].searchsorted(ahead))
                    c[0] = int(self.item[c[1]]) if c[1] < c[2] else -1
            cursors = [c for c in cursors if c[1] < c[2]]
        return out

    def _verified(self, p, block, at, term, owner, first, before, hashes, stride, found) -> None:
        d = owner[p]
        lo, hi = np.searchsorted(at, [p, p + 2 if p + 1 < len(owner) and owner[p + 1] == d else p + 1])
        own_terms = np.unique(term[lo:hi])
        hits = self.retrieved(own_terms, block, self.maxima(own_terms, block))
        if not hits:
            return
        start = before[d] + (p - first[d]) * stride
        passage = hashes[start : min(start + 2 * stride, before[d + 1])]
        own = {m: frozenset(grams(passage, m).tolist()) for m in range(1, GRAM + 1) if len(passage) >= m}
        for k, s in hits:
            sizes = [min(GRAM, n) for n in self.lengths[k]]
            if all(not part or len(part & own.get(m, frozenset())) >= OVERLAP * len(part) for part, m in zip(self.parts[k], sizes, strict=True)):
                found[d][k] = max(s, found[d].get(k, 0.0))


def parts_of(items: DataFrame) -> int:
    """How many indexes (item_id, question, answer) need."""
    n, chars = items.agg(F.count("*"), F.sum(F.length(F.concat_ws(" ", "question", "answer")))).first()
    return max(1, math.ceil(n / MOST_ITEMS), math.ceil((chars or 0) / MOST_CHARS))


def indexes(items: DataFrame, parts: int) -> Iterator[Index]:
    """Indexes of bounded size over (item_id, question, answer), one at a time; a null or empty answer leaves one part."""
    kept = items.withColumn("part", F.pmod(F.xxhash64("item_id", "question"), F.lit(parts)))

    def read(part: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
        out = []
        for r in kept.where(F.col("part") == part).select("item_id", "question", "answer").toLocalIterator():
            q, a = (terms_of([x or ""])[0] for x in (r.question, r.answer))
            out.append((r.item_id, q, a))
        return out

    df, words, size, longest = Counter(), 0, 0, 0
    for part in range(parts):
        own = read(part)
        for _, q, a in own:
            df.update(set(np.concatenate([q, a]).tolist()))
            words += len(q) + len(a)
            size += 1
            longest = max(longest, len(q) + len(a))
    idf = {t: math.log(1 + (size - k + 0.5) / (k + 0.5)) for t, k in df.items()}
    for part in range(parts):
        own = read(part) if parts > 1 else own
        yield Index(own, idf, words / max(size, 1) or 1.0, longest)


def contaminated(docs: DataFrame, items: DataFrame, into: str = "hits") -> DataFrame:
    """``docs`` with the column ``into``: an array of (item_id, score) of the verified items, by item; scores from 1 on.

    ``docs`` must not have a column of that name.
    """
    spark = prepare(docs.sparkSession)
    schema = docs.schema
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in schema)
    hit = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64())]))
    out = docs.withColumn(into, F.expr("cast(array() as array<struct<item_id: bigint, score: double>>)"))
    parts, held = parts_of(items), None
    for index in indexes(items, parts):
        carried = spark.sparkContext.broadcast(index)
        del index  # its broadcast copy is a file

        def run(batches: Iterator[pa.RecordBatch], carried=carried) -> Iterator[pa.RecordBatch]:
            index = carried.value
            for b in batches:
                hashes, before = hashed_words(*bytes_of(b.column("text")), lower=True, apart=APART)
                rows = [list(x or ()) for x in b.column(b.num_columns - 1).to_pylist()]
                for row, got in zip(rows, index.search(hashes, before), strict=True):
                    row += [{"item_id": index.ids[k], "score": s} for k, s in got.items()]
                rows = [sorted(x, key=lambda h: (h["item_id"] is None, h["item_id"] or 0, h["score"])) for x in rows]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, hit)], names=b.schema.names)

        out = out.mapInArrow(run, f"{kinds}, `{into}` array<struct<item_id: bigint, score: double>>")
        if parts > 1:
            out = written(out, "hits")
            carried.destroy()
            if held is not None:
                dropped(held)
            held = out
    return out


def benchmark_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"), F.lit(None).cast("string").alias("answer"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the test items that it holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contaminated(docs, benchmark_items(spark, sf_dir))
    ids = F.array_join(F.array_distinct(F.transform("hits", lambda h: h["item_id"].cast("string"))), ",")
    best = F.array_max(F.transform("hits", lambda h: h["score"])) * THRESHOLD
    return out.select("doc_id", F.size("hits").cast("bigint").alias("n_hits"), ids.alias("item_ids"), F.round(F.coalesce(best, F.lit(0.0)), 6).alias("best_score"), (F.size("hits") > 0).alias("contaminated"))
