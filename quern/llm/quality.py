"""Quality by supervised subword embeddings: learned vectors of hashed words and character n-grams, averaged per document.

A word is a longest run without ASCII white space, its case kept. A document's features are its words, its pairs of
neighbouring words (a word that repeats the one before gives the one pair that stands for any repetition) and the
byte n-grams of ``NGRAMS`` lengths inside its words; each falls by its hash into one of ``2 ** BITS`` buckets. A document
is the mean of its features' vectors, and a softmax over two outputs gives the probability of label 1.

Vectors and outputs are learned together by stochastic gradient descent in numpy, a document a step, with a rate that
falls to zero. As a mean and a product with the outputs may change places, scoring needs one number for each bucket: the
difference of its vector's two outputs. Executors get these numbers (1 MB), and score every byte of whole texts.

The sample is bounded: at most ``SAMPLE`` labelled rows, drawn by a hash of the id, of at most ``SAMPLE_CHARS`` characters
together; where they have more, the longest give windows spread over the whole text, as many as their equal share holds.
Rows that the sample has room for beyond its share are not used at all. It is cut and turned into features in the tasks,
before anything is collected.

Cases: null or empty text, or one without words, has no features and the score of the bias alone; a label that is null is
no label; several labels of a document count as 1 if one is; repeated rows give repeated results (and each counts as a row
of the sample); a null doc_id is not held out and has no label; without labels of either kind every score is the smoothed
share of label 1 (one half without any). Very long texts are worked through in pieces of 128 KB that end with a text, a
longer text is one piece. The output column must have a name that the documents lack.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, prepare, table, texts_of
from .hashing import U, slices, word_hashes, words_of
from .toxicity import share_of, spread

BITS, NGRAMS = 18, (2, 3, 4)
SAMPLE, SAMPLE_CHARS = 4000, 12_000_000
DIMENSIONS, EPOCHS, RATE, SEED = 16, 12, 0.5, 13
PAIR, ODD = U(0xD6E8FEB86659FD93), U(0x9E3779B97F4A7C15)
#: What any pair of equal words is taken for.
AGAIN = U(1)


def buckets(keys: np.ndarray) -> np.ndarray:
    """The highest bits of a product: buckets of 64-bit keys."""
    return ((keys * ODD) >> U(64 - BITS)).astype(np.int32)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of texts laid end to end, kind after kind, and the text that each is of."""
    start, end, before = words_of(data, offsets)
    if not len(start):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    of_word = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    words = word_hashes(data, start, end)
    inside = of_word[1:] == of_word[:-1]
    first, second = words[:-1][inside], words[1:][inside]
    pairs = np.where(first == second, AGAIN, first * PAIR + second)
    found, texts = [buckets(words), buckets(pairs)], [of_word, of_word[1:][inside]]
    # bytes of words, with the bytes that their word has left from there on
    size = end - start
    left = np.repeat(end, size)
    at = np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    left -= at
    own, text = data[at].astype(U), np.repeat(of_word, size)
    for n in NGRAMS:
        whole = np.flatnonzero(left >= n)
        key = np.full(len(whole), n, U)
        for k in range(n):
            key = (key << U(8)) | own[whole + k]
        found.append(buckets(key))
        texts.append(text[whole])
    return np.concatenate(found), np.concatenate(texts)


class Model:
    """One number for each bucket and the bias: what they add to the logit of label 1."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.full(len(offsets) - 1, self.bias)
        for a, b in slices(offsets):
            ids, texts = features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            total, n = np.bincount(texts, self.weights[ids], b - a), np.bincount(texts, minlength=b - a)
            out[a:b] += total / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def fit(sample: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """The model of documents (distinct buckets, how often each stands there, label)."""
    ones = sum(y for _, _, y in sample)
    if not 0 < ones < len(sample):
        return Model(np.zeros(1 << BITS, np.float32), float(np.log((ones + 1) / (len(sample) - ones + 1))))
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS)).astype(np.float32)
    outputs, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    known = [(ids, (n / n.sum()).astype(np.float32), y) for ids, n, y in sample if len(ids)]
    steps = EPOCHS * len(known)
    for step, k in enumerate(np.concatenate([rng.permutation(len(known)) for _ in range(EPOCHS)])):
        ids, share, y = known[k]
        rate = RATE * (1 - step / steps)
        mean = share @ vectors[ids]
        logits = outputs @ mean + bias
        wrong = np.exp(logits - logits.max())
        wrong /= wrong.sum()
        wrong[y] -= 1
        back = wrong @ outputs
        outputs -= rate * np.outer(wrong, mean)
        bias -= rate * 0.1 * wrong
        # a mean of a thousand features moves each by a thousandth; the share is scaled to a step that all texts can feel
        vectors[ids] -= (rate * np.sqrt(share))[:, None] * back
    return Model((vectors @ (outputs[1] - outputs[0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a bounded sample of labelled rows that are not held out."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where(~held_out(F.col("doc_id")))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    text = F.coalesce("text", F.lit(""))
    rows = docs.join(F.broadcast(drawn), "doc_id").select(F.xxhash64("doc_id").alias("h"), text.alias("text"), F.col("quality").cast("int").alias("quality"))
    # repeated rows of the ids drawn do not lift the bound
    rows = rows.orderBy("h", F.xxhash64("text")).limit(SAMPLE)
    share = share_of([r.n for r in rows.select(F.length("text").alias("n")).collect()], SAMPLE_CHARS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = bytes_of(pa.array([spread(t, share) for t in texts_of(b.column(1))], pa.string()))
            own = [np.unique(features(data[p:q], np.array([0, q - p]))[0], return_counts=True) for p, q in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([i.tobytes() for i, _ in own], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in own], pa.binary()), b.column(2)], names=["h", "ids", "n", "quality"])

    found = sorted((r.h, bytes(r.ids), bytes(r.n), int(r.quality > 0)) for r in rows.mapInArrow(cut, "h bigint, ids binary, n binary, quality int").collect())
    return fit([(np.frombuffer(i, np.int32), np.frombuffer(n, np.int32), y) for _, i, n, y in found])


def scored(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """``docs`` with the column ``into``, a name that they must not have."""
    spark = prepare(docs.sparkSession)
    carried = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(carried.value.scores(*bytes_of(b.column("text"))), pa.float64())], names=[*b.schema.names, into])

    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, `{into}` double")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, trained(docs, table(spark, sf_dir, "labels").select("doc_id", "quality")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
