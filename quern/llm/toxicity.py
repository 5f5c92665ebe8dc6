"""Toxicity by compression distance: windows of a text under a dictionary of toxic and one of ordinary text.

Two zstandard dictionaries are trained on one part of a labelled sample: the ordinary one on windows of ordinary
documents, the toxic one on windows of toxic documents, without the terms that do not stand in significantly more toxic
than ordinary documents: toxic documents are mostly ordinary text, and fragments of that would only blur the comparison.
How significant (two-proportion z of at least one of ``CUTS``) is what gives the least log loss on the calibrating rows:
the more documents, the more terms pass a cut by chance or by their language. For the same reason the toxic dictionary is used in front of the ordinary one,
so that a window is shorter under it only for what toxic text has of its own.

A text is cut into windows of ``WINDOW`` words. The bytes that the toxic dictionary saves against the ordinary one give
three features (the most saved in a window, the number and the share of windows that save ``SAVED`` bytes or more). A
logistic curve calibrates them on the other part of the sample, which no dictionary has seen; 0.5 is its threshold.

The sample is bounded: at most ``SAMPLE`` labelled rows, drawn by a hash of the id, of at most ``SAMPLE_CHARS``
characters together. Where their texts have more, none is left out: the longest give windows spread over the whole text
instead, as many as their equal share of the characters holds, cut before they leave their tasks. Everything else
covers all windows of all whole texts.

Cases: null or empty text has no windows and the score of a text that saves nothing; a label that is null is no label;
several labels of a document count as toxic if one is; repeated rows give repeated results; without toxic or without
ordinary labels every score is the smoothed share of toxic labels (0 where there is none). The output column must have
a name that the documents lack.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, texts_of

WINDOW, LONGEST, SAVED, LEAST, CUTS = 8, 1000, 2, 5, (5.0, 7.0, 9.0, 12.0)
SAMPLE, SAMPLE_CHARS, LEVEL = 6000, 24_000_000, 9
#: Bytes of the dictionaries, and the segments and substrings that their training counts.
ORDINARY, TOXIC = {"dict_size": 12_000, "k": 48, "d": 8}, {"dict_size": 2048, "k": 32, "d": 8}
#: Of ten sampled documents, so many calibrate; the others train the dictionaries.
CALIBRATE = 4
TERM = re.compile(r"[^\W\d_]+")


def windows(text: str) -> list[bytes]:
    words = text.lower().split()
    whole = (f" {' '.join(words[k : k + WINDOW])} " for k in range(0, len(words), WINDOW))
    return [w[k : k + LONGEST].encode() for w in whole for k in range(0, len(w), LONGEST)]


class Model:
    """The ordinary dictionary, the toxic one, and the curve's weights; small, and the same for every text."""

    def __init__(self, dictionaries: list[bytes], weights: list[float]):
        self.dictionaries, self.weights = dictionaries, weights

    def compressors(self):
        import zstandard as z

        out = []
        for data in self.dictionaries:
            kept = z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT)
            kept.precompute_compress(level=LEVEL)
            out.append(z.ZstdCompressor(dict_data=kept, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        return out

    def features(self, texts: list[str]) -> np.ndarray:
        ordinary, toxic = self.compressors()
        out = np.zeros((len(texts), 4))
        out[:, 0] = 1
        for row, text in zip(out, texts, strict=True):
            if own := windows(text):
                saved = [len(ordinary(w)) - len(toxic(w)) for w in own]
                hits = sum(s >= SAVED for s in saved)
                row[1:] = min(max(max(saved), 0), 12), math.log1p(hits), hits / len(saved)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        if not self.dictionaries:
            return np.full(len(texts), self.weights[0])
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ np.array(self.weights), -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Logistic regression by Newton's method; the ridge doesn't hold the first weight."""
    w, hold = np.zeros(x.shape[1]), ridge * np.diag([0.0, *[1.0] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold + 1e-9 * np.eye(len(w)), x.T @ (y - p) - hold @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def dictionary(own: list[bytes], kind: dict[str, int]) -> bytes:
    """A dictionary trained on windows; of too few to choose from, their last bytes."""
    import zstandard as z

    try:
        return z.train_dictionary(kind["dict_size"], own, k=kind["k"], d=kind["d"], level=LEVEL).as_bytes()
    except z.ZstdError:
        return b"".join(own)[-kind["dict_size"] :]


def telling(toxic: list[str], ordinary: list[str]) -> dict[str, float]:
    """Terms of at least ``LEAST`` toxic texts, with how significantly (z) they stand in more of these than of ordinary texts."""
    had = [Counter(w for t in texts for w in set(TERM.findall(t.lower()))) for texts in (toxic, ordinary)]
    n, m, out = len(toxic), len(ordinary), {}
    for w, a in had[0].items():
        p = (a + had[1][w]) / (n + m)
        if a >= LEAST and p < 1:
            out[w] = (a / n - had[1][w] / m) / math.sqrt(p * (1 - p) * (1 / n + 1 / m))
    return out


def fit(sample: list[tuple[str, int]]) -> Model:
    """The model of (text, toxic) rows in an order that says nothing about them."""
    toxic, ordinary = ([k for k, (_, y) in enumerate(sample) if y == x] for x in (1, 0))
    if not toxic or not ordinary:
        return Model([], [(len(toxic) + 0.0) / (len(sample) + 1)])
    # both parts have both kinds, unless there is a single row of one
    part = lambda rows, keep: [rows[k] for k in range(len(rows)) if keep(k % 10 >= CALIBRATE)] or rows
    texts = lambda rows: [sample[k][0] for k in part(rows, bool)]
    z = telling(texts(toxic), texts(ordinary))
    base = dictionary([w for t in texts(ordinary) for w in windows(t)], ORDINARY)
    rows = [sample[k] for rows in (toxic, ordinary) for k in part(rows, lambda train: not train)]
    y = np.array([y for _, y in rows], float)
    best = math.inf
    for cut in CUTS:
        own = [" ".join(w for w in TERM.findall(t.lower()) if z.get(w, -math.inf) >= cut) for t in texts(toxic)]
        one = Model([base, dictionary([w for t in own for w in windows(t)], TOXIC) + base], [])
        x = one.features([t for t, _ in rows])
        one.weights = fit_curve(x, y)
        p = 1 / (1 + np.exp(-np.clip(x @ np.array(one.weights), -30, 30)))
        loss = -float(np.mean(np.log(np.where(y > 0, p, 1 - p))))
        if loss < best:
            best, model = loss, one
    return model


def share_of(lengths: list[int], most: int) -> int:
    """The greatest length to which all can be cut so that they have at most ``most`` characters together."""
    left = most
    for k, n in enumerate(ordered := sorted(lengths)):
        if n * (len(ordered) - k) > left:
            return left // (len(ordered) - k)
        left -= n
    return most


def spread(text: str, most: int) -> str:
    """The text, or windows evenly spread over it, of at most ``most`` characters."""
    if len(text) <= most:
        return text
    words = text.split()
    whole = (" ".join(words[k : k + WINDOW]) for k in range(0, len(words), WINDOW))
    own = [w[k : k + LONGEST] for w in whole for k in range(0, len(w), LONGEST)]
    n = min(len(own), most * len(own) // max(1, sum(map(len, own)) + len(own)))
    while True:
        drawn = " ".join(own[k * len(own) // n] for k in range(n))
        if len(drawn) <= most:
            return drawn
        n -= max(1, n // 50)


def held_out(key: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a bounded sample of labelled documents that are not held out."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    rows = docs.join(F.broadcast(drawn), "doc_id").select(F.xxhash64("doc_id").alias("h"), F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    # repeated rows of the ids drawn do not lift the bound
    rows = rows.orderBy("h", F.xxhash64("text")).limit(SAMPLE)
    share = share_of([r.n for r in rows.select(F.length("text").alias("n")).collect()], SAMPLE_CHARS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([spread(t, share) for t in texts_of(b.column(1))], pa.string()), b.column(2)], names=["h", "text", "toxic"])

    return fit([(r.text, r.toxic) for r in sorted(rows.mapInArrow(cut, "h bigint, text string, toxic int").collect())])


def scored(docs: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """``docs`` with the column ``into``, a name that they must not have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.scores(texts_of(b.column("text"))))], names=[*b.schema.names, into])

    prepare(docs.sparkSession)
    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema)
    return docs.mapInArrow(run, f"{kinds}, `{into}` double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, trained(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
