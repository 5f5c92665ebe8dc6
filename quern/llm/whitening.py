"""Whitening of vectors by LOBPCG: the leading eigenvectors of their covariance, found without forming it.

A pass over the rows multiplies the covariance with a block of vectors: each task centres its rows, multiplies them with
the block, and the products with the rows again; it sends one row for each dimension, and these are summed by
dimension. So a pass moves dimensions x block numbers a task, whatever the number of rows, and the driver holds a few
such blocks and nothing that grows with the rows.

An iteration joins the iterate, its residual and the previous direction to one orthonormal block, takes its product
in one pass, and solves the small problem that these span (Rayleigh-Ritz). The product of the new iterate follows from
that of the block, so each iteration knows its true residuals. It ends when those of all components asked for are below
``TOLERANCE`` times the greatest eigenvalue, or no longer fall and are below ``CERTIFIED`` times it; else, after ``ROUNDS``,
it is an error. The iterate has ``GUARD`` vectors more than are asked for, which are not waited for.

Numbers are whole ones: an entry c counts as floor(1024 * c) + 100000, and sums are exact (decimals of 38 digits). A row is
centred as (n * x - sum) / n, whose numerator is exact up to 2 ** 62, in floating point beyond.

Cases: rows whose vector is null or has null or non-finite entries go, rows with a null id stay; vectors of unlike size
are an error; repeated rows count as often as they stand there and give repeated results; ties between eigenvalues give any
basis of what they span; a component without variance (an eigenvalue below ``FLAT`` times the trace) cannot be
whitened and has no rows, so a single vector, equal vectors, empty vectors and an empty table give none. ``deviation`` is
null where it exceeds 64 bits, ``deviation_exact`` is it in any case up to 38 digits. Entries beyond 2 ** 52 count as that.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table

COMPONENTS, GUARD = 8, 8
TOLERANCE, CERTIFIED, FLAT, ROUNDS = 1e-14, 1e-11, 1e-13, 300
SCALE, SHIFT, LARGEST, EXACT = 1024.0, 100_000, float(1 << 52), 1 << 62
SEED = 11


def sound_rows(rows: DataFrame, vector: str) -> DataFrame:
    """``rows`` whose vector is there and has finite numbers only, as doubles."""
    kept = rows.withColumn(vector, F.col(vector).cast("array<double>")).where(F.col(vector).isNotNull())
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return kept.where(F.forall(vector, finite))


def whole(column: pa.Array, size: int | None = None) -> np.ndarray:
    """Vectors of one size as whole numbers, a row each."""
    lengths = np.unique(column.value_lengths().to_numpy())
    if len(lengths) > 1 or size is not None and any(lengths != size):
        raise ValueError("vectors must have one size")
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.floor(np.clip(SCALE * x, -LARGEST, LARGEST)).astype(np.int64) + SHIFT


class Centre:
    """Number of rows and exact sums: what centres a row."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array(sums, np.int64) if all(abs(s) < EXACT for s in sums) else None

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - sum, in whole numbers where they fit, else as Python's."""
        if self.whole is not None and (not x.size or int(np.abs(x).max()) * self.n < EXACT):
            return x * self.n - self.whole
        return x.astype(object) * self.n - np.array(self.sums, object)

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(np.float64) / self.n


def centre(rows: DataFrame, vector: str) -> Centre | None:
    """Of sound rows, in one pass; None where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for b in batches:
            if b.num_rows:
                x = whole(b.column(0), None if sums is None else len(sums))
                most = int(np.abs(x).max(initial=0)) * len(x)
                own = x.sum(axis=0).tolist() if most < EXACT else x.astype(object).sum(axis=0).tolist()
                n, sums = n + len(x), own if sums is None else [a + c for a, c in zip(sums, own, strict=True)]
        if n:
            # the number of rows stands beside the sums, and so does the number of dimensions
            values = [Decimal(v) for v in [n, *sums]]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(sums)), pa.int32()), pa.array(values, pa.decimal128(38, 0)), pa.array([len(sums)] * len(values), pa.int32())], names=["k", "v", "size"])

    parts = rows.select(vector).mapInArrow(run, "k int, v decimal(38,0), size int")
    found = parts.groupBy("k").agg(F.sum("v").alias("v"), F.min("size").alias("least"), F.max("size").alias("most")).collect()
    if any(r.least != r.most for r in found):
        raise ValueError("vectors must have one size")
    held = {r.k: int(r.v) for r in found}
    return Centre(held[-1], [held[k] for k in range(len(held) - 1)]) if held else None


def product(rows: DataFrame, vector: str, middle: Centre, block: np.ndarray) -> tuple[np.ndarray, float]:
    """The covariance times ``block`` (a row for each dimension), and the covariance's trace: one pass."""
    d, m = block.shape
    carried = rows.sparkSession.sparkContext.broadcast((middle, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle, block = carried.value
        total, squares, n = np.zeros((d, m)), np.zeros(d), 0
        for b in batches:
            if b.num_rows:
                x = middle.rows(whole(b.column(0), d))
                total += x.T @ (x @ block)
                squares += (x * x).sum(axis=0)
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(squares), *map(pa.array, total.T)], names=["k", "s", *(f"c{j}" for j in range(m))])

    columns = ["s", *(f"c{j}" for j in range(m))]
    parts = rows.select(vector).mapInArrow(run, ", ".join(["k int", *(f"{c} double" for c in columns)]))
    found = np.zeros((d, m + 1))
    for r in parts.groupBy("k").agg(*(F.sum(c).alias(c) for c in columns)).collect():
        found[r.k] = r[1:]
    carried.unpersist()
    return found[:, 1:] / middle.n, float(found[:, 0].sum() / middle.n)


def orthonormal(blocks: list[np.ndarray]) -> np.ndarray:
    """One orthonormal block that spans those, by their order; what lies in earlier ones goes."""
    out = np.zeros((blocks[0].shape[0], 0))
    for b in blocks:
        norms = np.linalg.norm(b, axis=0)
        b = b[:, norms > 0] / norms[norms > 0]
        for _ in range(2):
            b = b - out @ (out.T @ b)
            if b.size:
                u, s, _ = np.linalg.svd(b, full_matrices=False)
                b = u[:, s > 1e-10]
        out = np.hstack([out, b])
    return out


class Spectrum:
    """Leading components (columns), their eigenvalues, the trace, the greatest residual relative to the greatest
    eigenvalue, and the number of passes."""

    def __init__(self, vectors: np.ndarray, values: np.ndarray, trace: float, residual: float, passes: int):
        self.vectors, self.values, self.trace, self.residual, self.passes = vectors, values, trace, residual, passes


def spectrum(rows: DataFrame, vector: str, middle: Centre, k: int = COMPONENTS, tolerance: float = TOLERANCE) -> Spectrum:
    """The first ``k`` eigenvectors of the covariance of sound rows, fewer where fewer have variance."""
    d = len(middle.sums)
    k, m = min(k, d), min(k + GUARD, d)
    block = orthonormal([np.random.default_rng(SEED).standard_normal((d, m))]) if d else np.zeros((0, 0))
    if not d:
        return Spectrum(block, np.zeros(0), 0.0, 0.0, 0)
    direction, least, still = np.zeros((d, 0)), np.inf, 0
    for passes in range(1, ROUNDS + 1):
        image, trace = product(rows, vector, middle, block)
        small = block.T @ image
        values, mixing = np.linalg.eigh((small + small.T) / 2)
        values, mixing = values[::-1][:m], mixing[:, ::-1][:, :m]
        iterate, after = block @ mixing, image @ mixing
        residual = after - iterate * values
        top = max(values[0], 0.0)
        left = np.linalg.norm(residual[:, :k], axis=0).max() / top if top > 0 else 0.0
        still = 0 if left < 0.5 * least else still + 1
        least = min(least, left)
        if top <= 0 or left <= tolerance or left <= CERTIFIED and still >= 3 or block.shape[1] == d:
            break
        # what the block's other parts gave to the iterate: the direction to go on in
        held = mixing.copy()
        held[:m] = 0
        direction = block @ held if block.shape[1] > m else direction
        block = orthonormal([iterate, residual, direction])
    else:
        raise ArithmeticError(f"residuals are still {left:.1e} of the greatest eigenvalue after {ROUNDS} passes")
    seen = values[:k] > FLAT * max(trace, 0.0)
    return Spectrum(iterate[:, :k][:, seen], values[:k][seen], trace, float(left), passes)


class Whitening:
    """A centre and a spectrum; ``matrix`` brings centred rows to unit covariance."""

    def __init__(self, middle: Centre, found: Spectrum):
        self.middle, self.found = middle, found
        self.matrix = found.vectors / np.sqrt(found.values)


def fitted(rows: DataFrame, vector: str = "vector", k: int = COMPONENTS) -> Whitening | None:
    """The whitening of all sound rows; None where there is none."""
    prepare(rows.sparkSession)
    kept = sound_rows(rows, vector)
    middle = centre(kept, vector)
    return None if middle is None else Whitening(middle, spectrum(kept, vector, middle, k))


def identity_error(rows: DataFrame, vector: str, model: Whitening) -> float:
    """The greatest absolute entry of the whitened rows' covariance minus the identity: one pass over all rows. Their mean
    is zero, as the rows are centred by their exact mean."""
    k = model.matrix.shape[1]
    if not k:
        return 0.0
    carried = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = carried.value, np.zeros((k, k))
        for b in batches:
            if b.num_rows:
                z = model.middle.rows(whole(b.column(0), model.matrix.shape[0])) @ model.matrix
                total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), *map(pa.array, total.T)], names=["k", *(f"c{j}" for j in range(k))])

    columns = [f"c{j}" for j in range(k)]
    parts = sound_rows(rows, vector).select(vector).mapInArrow(run, ", ".join(["k int", *(f"{c} double" for c in columns)]))
    found = np.array([r[1:] for r in parts.groupBy("k").agg(*(F.sum(c).alias(c) for c in columns)).orderBy("k").collect()])
    return float(np.abs(found / model.middle.n - np.eye(k)).max())


def whitened(rows: DataFrame, model: Whitening, vector: str = "vector", into: str = "whitened") -> DataFrame:
    """Sound rows with their whitened vector and ``deviation_exact``, the sum over dimensions of (n * x - sum) squared."""
    spark = rows.sparkSession
    carried = spark.sparkContext.broadcast(model)
    kept = sound_rows(rows, vector)
    k = model.matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = carried.value
        for b in batches:
            if not b.num_rows:
                continue
            far = model.middle.scaled(whole(b.column(b.schema.get_field_index(vector)), model.matrix.shape[0]))
            z = (far.astype(np.float64) / model.middle.n) @ model.matrix
            # squares as whole numbers where their sum fits, else as Python's
            fits = far.dtype != object and float(np.abs(far).max(initial=0)) ** 2 * far.shape[1] < EXACT
            squares = (far * far if fits else far.astype(object) ** 2).sum(axis=1).tolist()
            exact = pa.array([Decimal(v) if abs(v) < 10**38 else None for v in squares], pa.decimal128(38, 0))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * k, pa.int32()), pa.array(z.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, exact], names=[*b.schema.names, into, "deviation_exact"])

    kinds = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in kept.schema)
    return kept.mapInArrow(run, f"{kinds}, `{into}` array<double>, deviation_exact decimal(38,0)")


def as_long(value: Column) -> Column:
    """A decimal as long, null where it does not fit."""
    return F.when(F.abs(value) < Decimal(1 << 63), value).cast("bigint")


RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact decimal(38,0), residual double"


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each sound vector and component."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    model = fitted(rows)
    if model is None:
        return prepare(spark).createDataFrame([], RESULT)
    found, error = model.found, identity_error(rows, "vector", model)
    share = F.array(*(F.lit(float(e / found.trace)) for e in found.values)).cast("array<double>")
    each = whitened(rows, model).select("vec_id", "deviation_exact", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.middle.n).cast("bigint").alias("n"),
        as_long(F.col("deviation_exact")).alias("deviation"),
        "whitened",
        F.get(share, F.col("at")).alias("explained"),
        F.lit(error).alias("identity_error"),
        "deviation_exact",
        F.lit(found.residual).alias("residual"),
    )
