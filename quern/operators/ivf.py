"""Approximate nearest neighbours by cosine distance: an inverted file of trained centroids with residual codes.

Centroids are trained by spherical k-means on a bounded sample. A vector belongs to the list of its nearest centroid and is
kept twice: as a code, the difference to the centroid with a byte a dimension, in packs of up to ``PACK`` codes of one list,
and as it is. A search sends each query to the lists of its ``probes`` nearest centroids: queries stay a DataFrame, are
packed by list and meet the lists' packs by a join. Codes give each query its ``REFINE * k`` best candidates, and their
distances are then computed from the vectors themselves, so distances are exact and only the choice is approximate.

``probes`` is a parameter of the search; by default it is the least that finds ``RECALL`` of the true neighbours of drawn
queries in the sample. The driver holds the sample (at most ``SAMPLE`` vectors of ``SAMPLE_BYTES`` together) and the centroids
(at most ``CENTROID_BYTES``), no query and no vector besides. A list that a third of all vectors fall into is many packs,
spread by Spark's rebalancing when it is written and by its skew join when it is searched.

Cases: vectors that are null, zero or not finite are in no list and are no queries; vectors of unlike size are an error;
ties in distance go by id; repeated ids are rows of their own; an empty table has no neighbours.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType

from ..errors import EmbeddingError, VectorStoreError
from ..sources.log import Versioned, name_of

SAMPLE, SAMPLE_BYTES, CENTROID_BYTES, MOST_LISTS = 50_000, 64 << 20, 32 << 20, 4096
ITERATIONS, DRAWN, RECALL, TARGET_K, SEED = 12, 200, 0.97, 10, 7
PACK, QUERY_PACK, REFINE = 256, 64, 4
#: Candidates up to so many rows (some 100 MB) are broadcast to the vectors.
BROADCAST_CANDIDATES = 1_000_000


def usable(rows: DataFrame) -> DataFrame:
    """Rows whose ``vector``, as doubles, has a direction."""
    kept = rows.withColumn("vector", F.col("vector").cast("array<double>")).where("vector is not null")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return kept.where(finite & F.exists("vector", lambda x: x != 0))


def unit(column: pa.Array) -> np.ndarray:
    """Vectors of one size, of length 1, a row each."""
    sizes = np.unique(column.value_lengths().to_numpy())
    if len(sizes) > 1:
        raise EmbeddingError("vectors must have one size")
    m = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def trained(sample: np.ndarray, lists: int) -> np.ndarray:
    """Spherical k-means: centroids of length 1; an empty one is drawn anew."""
    rng = np.random.default_rng(SEED)
    centroids = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(ITERATIONS):
        near = np.concatenate([(part @ centroids.T).argmax(axis=1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        total = np.zeros_like(centroids)
        np.add.at(total, near, sample)
        norm = np.sqrt((total * total).sum(axis=1))
        lost = norm < 1e-12
        total[lost], norm[lost] = sample[rng.choice(len(sample), int(lost.sum()))], 1
        centroids = total / norm[:, None]
    return centroids


def enough_probes(sample: np.ndarray, centroids: np.ndarray) -> int:
    """The least number of lists that hold ``RECALL`` of the drawn queries' neighbours in the sample."""
    drawn = np.random.default_rng(SEED).choice(len(sample), min(DRAWN, len(sample)), replace=False)
    far = sample[drawn] @ sample.T
    far[np.arange(len(drawn)), drawn] = -2
    k = min(TARGET_K, len(sample) - 1)
    if not k:
        return 1
    true = np.argpartition(-far, k - 1, axis=1)[:, :k]
    own = np.concatenate([(part @ centroids.T).argmax(axis=1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
    # the place of each centroid in each query's order; a neighbour is found when its list's place is probed
    order = np.argsort(-(sample[drawn] @ centroids.T), axis=1)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :].repeat(len(drawn), axis=0), axis=1)
    needed = np.sort(np.take_along_axis(place, own[true], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))) - 1)]) + 1


def packed(rows: DataFrame, most: int, fields: list[StructField]) -> DataFrame:
    """Rows (list, ...) with the values of up to ``most`` consecutive rows of a list as arrays."""
    names = [f.name for f in fields]
    kinds = [pa.list_(to_arrow_type(f.dataType)) for f in fields]
    schema = StructType([StructField("list", IntegerType()), *(StructField(f.name, ArrayType(f.dataType)) for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("list").to_numpy()
            # each run of one list, in parts
            edges = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]])) if len(own) else []
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                for at in range(s, e, most):
                    n = min(most, e - at)
                    parts = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), b.column(c).slice(at, n).cast(k.value_type)) for c, k in zip(names, kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([own[at]], pa.int32()), *parts], names=["list", *names])

    return rows.select("list", *names).hint("rebalance", "list").sortWithinPartitions("list").mapInArrow(run, schema)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


class IvfIndex(Versioned):
    def build(self, vectors: DataFrame, lists: int | None = None) -> None:
        """Index (id, vector[, owner]), whatever was indexed before. ``lists`` is by default the root of the sample's size
        times four, as many as fit their bounds."""
        owner = F.col("owner") if "owner" in vectors.columns else F.lit(None)
        rows = usable(vectors.select("id", "vector", owner.cast("string").alias("owner")))
        size = (rows.select(F.size("vector").alias("n")).first() or [0])[0]
        base = self.find_version()
        key = uuid.uuid4().hex
        limit = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, size))))
        drawn = rows.select(F.xxhash64("id").alias("h"), "vector").orderBy("h").limit(limit).toArrow()
        sample = unit(pa.array(drawn.column("vector").to_pylist(), pa.list_(pa.float64()))) if drawn.num_rows else np.zeros((0, 0))
        most = min(len(sample), MOST_LISTS, CENTROID_BYTES // (8 * max(1, size)))
        count = max(1, min(lists or int(4 * np.sqrt(len(sample))), most)) if len(sample) else 0
        centroids = trained(sample, count) if count else np.zeros((0, size))
        probes = enough_probes(sample, centroids) if count else 0
        carried = self.spark.sparkContext.broadcast(centroids)
        id_type = rows.schema["id"]

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids = carried.value
            for b in batches:
                if not b.num_rows:
                    continue
                m = unit(b.column("vector"))
                if m.shape[1] != centroids.shape[1]:
                    raise EmbeddingError("vectors must have one size")
                near = (m @ centroids.T).argmax(axis=1).astype(np.int32)
                left = m - centroids[near]
                scale = np.maximum(np.abs(left).max(axis=1), 1e-30)
                code = np.rint(left / scale[:, None] * 127).astype(np.int8)
                # a code is its bytes behind its scale
                whole = np.hstack([scale.astype("<f4").view(np.uint8).reshape(len(m), 4), code.view(np.uint8)])
                codes = pa.array([x.tobytes() for x in whole], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(near), *(b.column(c) for c in ("id", "owner")), codes, b.column("vector")], names=["list", "id", "owner", "code", "vector"])

        kinds = StructType([StructField("list", IntegerType()), id_type, StructField("owner", StringType()), StructField("code", BinaryType()), rows.schema["vector"]])
        assigned = rows.mapInArrow(assign, kinds)
        assigned.write.parquet(f"{self.root}/vectors/{key}")
        held = self.spark.read.schema(kinds).parquet(f"{self.root}/vectors/{key}")
        packs = packed(held, PACK, [id_type, StructField("owner", StringType()), StructField("code", BinaryType())])
        packs.write.parquet(f"{self.root}/packs/{key}")
        told = {"key": key, "size": size, "lists": len(centroids), "probes": probes, "vectors": kinds.json(), "packs": packs.schema.json(), "centroids": base64.b64encode(centroids.astype("<f8").tobytes()).decode()}
        if not self._create(f"log/{name_of(int(base[1:]) + 1 if base else 1)}.json", json.dumps(told)):
            raise VectorStoreError("another writer has changed the index; build again")
        carried.unpersist()

    def state(self) -> dict:
        if (found := self.find_version()) is None:
            raise VectorStoreError("nothing is indexed yet")
        held = json.loads(self._read(f"log/{found}.json"))
        held["centroids"] = np.frombuffer(base64.b64decode(held["centroids"]), "<f8").reshape(held["lists"], held["size"])
        return held

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
        """(query_id, id, distance, rank) of queries (query_id, vector[, scope]); a scope is the owner whose vectors count, null
        is none. Distances are exact and rounded to 9 digits."""
        state = self.state()
        id_type = StructType.fromJson(json.loads(state["vectors"]))["id"]
        query_type = queries.schema["query_id"]
        found = StructType([query_type, id_type, *StructType.fromDDL("distance double").fields])
        if not state["lists"]:
            return self.spark.createDataFrame([], found.add("rank", IntegerType()))
        n, depth, scoped = min(probes or state["probes"], state["lists"]), REFINE * k, "scope" in queries.columns
        scope = F.col("scope") if scoped else F.lit(None)
        asked = usable(queries.select("query_id", "vector", scope.cast("string").alias("scope")))
        carried = self.spark.sparkContext.broadcast(state["centroids"])
        sent = StructType([StructField("list", IntegerType()), query_type, StructField("scope", StringType()), StructField("query", BinaryType())])

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row for each query and list that it probes."""
            centroids = carried.value
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    b = whole.slice(at, 1024)
                    m = unit(b.column("vector"))
                    if m.shape[1] != centroids.shape[1]:
                        raise EmbeddingError("query vectors must have the size of the indexed ones")
                    near = np.argpartition(-(m @ centroids.T), n - 1, axis=1)[:, :n].astype(np.int32)
                    of = pa.array(np.repeat(np.arange(len(m)), n))
                    data = pa.array([x.tobytes() for x in m.astype("<f4")], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), b.column("query_id").take(of), b.column("scope").take(of), data.take(of)], names=["list", "query_id", "scope", "query"])

        groups = packed(asked.mapInArrow(send, sent), QUERY_PACK, list(sent.fields[1:]))
        packs = self.spark.read.schema(StructType.fromJson(json.loads(state["packs"]))).parquet(f"{self.root}/packs/{state['key']}")
        met = groups.join(packs, "list")
        near_type = StructType([query_type, id_type, *StructType.fromDDL("near double").fields])
        of_query, of_id, most = to_arrow_type(query_type.dataType), to_arrow_type(id_type.dataType), depth

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of each query in a pair of packs, the nearest by code."""
            centroids = carried.value
            for b in batches:
                for r in range(b.num_rows):
                    q = np.frombuffer(b"".join(b.column("query")[r].as_py()), "<f4").reshape(-1, centroids.shape[1])
                    raw = np.frombuffer(b"".join(b.column("code")[r].as_py()), np.uint8).reshape(-1, centroids.shape[1] + 4)
                    scale = raw[:, :4].copy().view("<f4")
                    m = centroids[b.column("list")[r].as_py()] + raw[:, 4:].view(np.int8) * (scale / 127.0)
                    near = q @ m.T.astype(np.float32)
                    if scoped:
                        scopes, owners = (np.array(b.column(c)[r].as_py(), object) for c in ("scope", "owner"))
                        near[(scopes[:, None] != owners) & np.array([s is not None for s in scopes])[:, None]] = -np.inf
                    if near.shape[1] > most:
                        column = np.argpartition(-near, most - 1, axis=1)[:, :most]
                    else:
                        column = np.arange(near.shape[1])[None, :].repeat(len(near), axis=0)
                    row = np.repeat(np.arange(len(near)), column.shape[1])
                    column = column.ravel()
                    seen = near[row, column] > -np.inf
                    row, column = row[seen], column[seen]
                    yield pa.RecordBatch.from_arrays([b.column("query_id")[r].values.take(pa.array(row)).cast(of_query), b.column("id")[r].values.take(pa.array(column)).cast(of_id), pa.array(near[row, column].astype(np.float64))], names=["query_id", "id", "near"])

        best = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
        candidates = met.mapInArrow(meet, near_type).withColumn("r", F.row_number().over(best)).where(F.col("r") <= depth).select("query_id", "id").distinct()
        vectors = self.spark.read.schema(StructType.fromJson(json.loads(state["vectors"]))).parquet(f"{self.root}/vectors/{state['key']}").select("id", "vector", "owner")
        # the query's vector comes back by its number: it is not carried through the search
        own = asked.select("query_id", F.col("vector").alias("query"), "scope")
        paired = candidates.join(own, "query_id")
        if queries.count() * depth <= BROADCAST_CANDIDATES:
            paired = F.broadcast(paired)
        paired = vectors.join(paired, "id")
        if scoped:
            paired = paired.where(F.col("scope").isNull() | (F.col("scope") == F.col("owner")))
        length = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
        distance = F.round(1 - dot(F.col("query"), F.col("vector")) / (length("query") * length("vector")), 9)
        order = Window.partitionBy("query_id").orderBy("distance", "id")
        return paired.select("query_id", "id", distance.alias("distance")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours (query_id, id) that were found."""
    row = exact.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left").agg(F.count("*").alias("n"), F.sum("hit").alias("hits")).first()
    return (row.hits or 0) / row.n if row.n else 1.0
