"""Exact nearest neighbours by cosine distance.

A stated set of query vectors meets all rows in blocks: each pass over the rows carries query vectors of up to
``PASS_BYTES``, as matrices of at most ``QUERIES`` rows. A product of such a matrix and ``ROWS`` vectors leaves only the
``k`` nearest of each query, and only those leave the task. What is shuffled follows queries and batches, not their
product. Rows and queries without a vector, and zero vectors, have no distance and no neighbours; vectors of unlike size
are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from ..errors import EmbeddingError

QUERIES, ROWS, PASS_BYTES = 4096, 2048, 32 << 20


def _passes(queries: DataFrame) -> Iterator[list[tuple]]:
    """Queries (query_id, vector, scope) as lists of (ids, matrix, scopes) for one pass each, in order."""
    blocks: list[tuple] = []
    rows: list = []
    size = 0

    def block() -> tuple:
        if len({len(r.vector) for r in rows}) > 1:
            raise EmbeddingError("query vectors must have one size")
        return [r.query_id for r in rows], np.array([r.vector for r in rows], np.float64), np.array([r.scope for r in rows], object)

    for r in queries.where("vector is not null").toLocalIterator():
        rows.append(r)
        size += 8 * len(r.vector)
        if len(rows) == QUERIES or size >= PASS_BYTES:
            blocks.append(block())
            rows.clear()
        if size >= PASS_BYTES:
            yield blocks
            blocks, size = [], 0
    if rows:
        blocks.append(block())
    if blocks:
        yield blocks


def _least(far: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k least of each row by (value, own); NaN is none."""
    far = np.where(np.isnan(far), np.inf, far)
    near = far < np.inf
    if far.shape[1] > k:
        near &= far <= np.partition(far, k - 1, axis=1)[:, k - 1 : k]
    row, column = np.nonzero(near)
    order = np.lexsort((own[column], far[row, column], row))
    row, column = row[order], column[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], column[kept]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, scoped: bool = False) -> DataFrame:
    """(query_id, id, distance, rank), distances rounded to 9 digits, ties by id.

    vectors: (id, vector[, owner]); queries: (query_id, vector[, scope]). Ids are of any type that can be ordered. With
    ``scoped``, only rows whose owner is the query's scope count; a null scope is no restriction.
    """
    spark = vectors.sparkSession
    scope = F.col("scope") if "scope" in queries.columns else F.lit(None)
    owner = F.col("owner") if scoped else F.lit(None)
    rows = vectors.select("id", F.col("vector").cast("array<double>").alias("vector"), owner.cast("string").alias("owner")).where("vector is not null")
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), scope.cast("string").alias("scope"))
    schema = StructType([asked.schema["query_id"], rows.schema["id"], StructField("distance", DoubleType())])
    of_query, of_row = (to_arrow_type(schema[c].dataType) for c in ("query_id", "id"))

    def search(blocks: list[tuple]) -> DataFrame:
        carried = spark.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asked = [(pa.array(ids, of_query), q, np.sqrt((q * q).sum(axis=1)), scopes, np.array([s is not None for s in scopes])) for ids, q, scopes in carried.value]
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    b = whole.slice(at, ROWS)
                    flat = b.column("vector").flatten().to_numpy(zero_copy_only=False)
                    sizes = np.unique(b.column("vector").value_lengths().to_numpy())
                    if len(sizes) > 1 or any(q.shape[1] != sizes[0] for _, q, _, _, _ in asked):
                        raise EmbeddingError("vectors must have one size, that of the query vectors")
                    m = flat.reshape(b.num_rows, -1)
                    norm, ids_here = np.sqrt((m * m).sum(axis=1)), b.column("id")
                    # the place of each row's id among the batch's, null first as Spark sorts
                    own = np.empty(b.num_rows, np.int64)
                    own[pc.sort_indices(ids_here, null_placement="at_start").to_numpy()] = np.arange(b.num_rows)
                    owners = np.array(b.column("owner").to_pylist(), object) if scoped else None
                    for ids, q, q_norm, scopes, bound in asked:
                        with np.errstate(invalid="ignore", divide="ignore"):
                            far = np.round(1 - (q @ m.T) / (q_norm[:, None] * norm), 9)
                        if scoped:
                            far[(scopes[:, None] != owners) & bound[:, None]] = np.nan
                        row, column = _least(far, own, k)
                        if len(row):
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), ids_here.take(pa.array(column)).cast(of_row), pa.array(far[row, column])], names=["query_id", "id", "distance"])

        return rows.mapInArrow(run, schema)

    parts = [search(blocks) for blocks in _passes(asked)]
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def within(hits: DataFrame, threshold: float | None) -> DataFrame:
    """Hits at most so far away, and those without a distance; None keeps all."""
    return hits if threshold is None else hits.where(F.col("distance").isNull() | (F.col("distance") <= threshold))


def dimensions(vectors: DataFrame) -> DataFrame:
    """One row about (id, vector): n_vectors, n_dims (distinct sizes), min_dim, max_dim, valid."""
    size = F.size("vector")
    stats = vectors.agg(F.count("*").alias("n_vectors"), F.count_distinct(size).alias("n_dims"), F.min(size).alias("min_dim"), F.max(size).alias("max_dim"))
    return stats.withColumn("valid", F.coalesce((F.col("n_dims") == 1) & (F.col("min_dim") > 0), F.lit(False)))


def check_dimensions(vectors: DataFrame) -> None:
    if not dimensions(vectors).first().valid:
        raise EmbeddingError("vectors must have one size above zero")


def arity(texts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Texts (id) without a vector and vectors (id) without a text: (id, has_text, has_vector), only where one lacks."""
    t = texts.select("id").distinct().withColumn("has_text", F.lit(True))
    v = vectors.select("id").distinct().withColumn("has_vector", F.lit(True))
    both = t.join(v, "id", "full").select("id", F.coalesce("has_text", F.lit(False)).alias("has_text"), F.coalesce("has_vector", F.lit(False)).alias("has_vector"))
    return both.where(~(F.col("has_text") & F.col("has_vector")))
