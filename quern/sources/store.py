"""The table of chunks: layers of Parquet in hash buckets of document_id, and a log of manifests that tells which count.

A replacement writes only its own rows, as a new layer; nothing is rewritten. A row counts unless a later layer of its bucket
has its document, or says that it is gone; a reader joins only buckets that have more than one layer. Buckets with more
than ``MOST_LAYERS`` are written anew as one layer, alone.

A commit makes the next number's manifest (see ``log``), which fails if that is there; the writer then takes over the newer
state and tries the next number. As a layer counts by its place in the log and not by what it was based on, nothing has to
be written again, and no document is lost, however writers interleave; of two that replace one document, the later
commit's rows count.

What a replacement must fulfil is observed by the plan that writes it, so its rows are computed once: each chunk has a
vector, all of one size, that of the stored ones, and comes from the store's embedding model. If not, the layer is deleted
and no version knows of it. Rows with a ``reject_reason`` stand apart: they tell of documents that have no chunks now, whose
stored ones stay.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..errors import EmbeddingError, VectorStoreError
from .documents import all_chunks
from .log import Versioned, name_of

BUCKETS, MOST_LAYERS, MOST_CHANGES = 64, 8, 1000
#: Documents of the later layers, up to so many rows (some 50 MB), are broadcast to the rows that they may replace.
BROADCAST_IDS = 1_000_000
#: The bucket of rows that tell of rejected documents.
REJECTED = -1


@dataclass(frozen=True)
class Layer:
    """A folder of rows. ``buckets`` are those where it still counts; ``gone`` layers only name documents."""

    seq: int
    path: str
    schema: str
    rows: int
    buckets: list[int]
    gone: bool = False


@dataclass(frozen=True)
class Manifest:
    version: int
    epoch: str
    buckets: int
    last: int = 0
    model: str | None = None
    size: int | None = None
    layers: list[Layer] = field(default_factory=list)
    #: The last replacements and deletions of this epoch, for readers that know an older version.
    changes: list[Layer] = field(default_factory=list)

    def dump(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def load(cls, text: str) -> Manifest:
        found = json.loads(text)
        return cls(**{**found, **{k: [Layer(**x) for x in found[k]] for k in ("layers", "changes")}})


class ChunkStore(Versioned):
    """Readers see one version whole. Versions stay for readers that have begun with them until ``clean`` removes them."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        super().__init__(spark, root)
        self.buckets = buckets

    # versions

    def version(self) -> str:
        if (found := self.find_version()) is None:
            raise VectorStoreError("nothing is indexed yet")
        return found

    def manifest(self, version: str) -> Manifest:
        text = self._read(f"log/{version}.json")
        try:
            return Manifest.load(text)
        except (ValueError, KeyError, TypeError) as e:
            raise VectorStoreError(f"the manifest of {version} is lost") from e

    def current(self) -> Manifest | None:
        found = self.find_version()
        return None if found is None else self.manifest(found)

    # reading

    def _layer(self, layer: Layer, buckets: list[int] | None = None) -> DataFrame:
        kinds = StructType.fromJson(json.loads(layer.schema)).add("bucket", IntegerType())
        rows = self.spark.read.schema(kinds).parquet(f"{self.root}/{layer.path}")
        return rows.where(F.col("bucket").isin(layer.buckets if buckets is None else buckets))

    def _live(self, layers: list[Layer], only: list[int] | None = None) -> DataFrame:
        """The rows that count, with their bucket."""
        held = {b: sorted((x for x in layers if b in x.buckets), key=lambda x: x.seq) for b in {b for x in layers for b in x.buckets if only is None or b in only}}
        single = [b for b, own in held.items() if len(own) == 1]
        parts: list[DataFrame] = []
        later: list[DataFrame] = []
        stacked: list[DataFrame] = []
        n_later = 0
        for x in sorted(layers, key=lambda x: x.seq):
            own = [b for b in held if x in held[b]]
            if not x.gone:
                if alone := [b for b in own if b in single]:
                    parts.append(self._layer(x, alone))
                if deep := [b for b in own if b not in single]:
                    stacked.append(self._layer(x, deep).withColumn("_seq", F.lit(x.seq)))
            if above := [b for b in own if held[b][0] is not x]:
                later.append(self._layer(x, above).select("document_id", F.lit(x.seq).alias("_last")))
                n_later += x.rows
        if stacked:
            rows = stacked[0]
            for x in stacked[1:]:
                rows = rows.unionByName(x, allowMissingColumns=True)
            ids = later[0]
            for x in later[1:]:
                ids = ids.unionByName(x)
            last = ids.groupBy("document_id").agg(F.max("_last").alias("_last"))
            rows = rows.join(F.broadcast(last) if n_later <= BROADCAST_IDS else last, "document_id", "left")
            parts.append(rows.where(F.col("_last").isNull() | (F.col("_seq") == F.col("_last"))).drop("_seq", "_last"))
        if not parts:
            return self._layer(next((x for x in layers if not x.gone), layers[0]), [])
        out = parts[0]
        for x in parts[1:]:
            out = out.unionByName(x, allowMissingColumns=True)
        return out

    def read(self, version: str | None = None) -> DataFrame:
        """(document_id, page_number, chunk_index, text, token_count, embedding, ...) of the current version, or of another."""
        return self._live(self.manifest(version or self.version()).layers).drop("bucket", "reject_reason")

    def read_documents(self, document_ids: list[str]) -> DataFrame:
        """The rows of a few documents: only their buckets are read."""
        state = self.manifest(self.version())
        ids = self.spark.createDataFrame([(d,) for d in document_ids], "document_id string")
        found = [r.b for r in ids.select(self._bucket(F.col("document_id"), state.buckets).alias("b")).distinct().collect()]
        return self._live(state.layers, found).where(F.col("document_id").cast("string").isin(document_ids)).drop("bucket", "reject_reason")

    def all_chunks(self) -> DataFrame:
        """Every chunk with its id and without its vector, which the scan leaves out."""
        return all_chunks(self.read())

    def rejects(self, version: str) -> DataFrame:
        """(document_id, reject_reason) of the replacement that made this version."""
        layer = next(x for x in self.manifest(version).changes[::-1])
        names = [x["name"] for x in json.loads(layer.schema)["fields"]]
        rows = self._layer(layer, [REJECTED])
        return rows.select("document_id", "reject_reason" if "reject_reason" in names else F.lit(None).cast("string").alias("reject_reason"))

    def fresh(self, since: str) -> DataFrame:
        """The rows that count of the documents in ``changes(since)``, read from what was written since."""
        then = self.manifest(since)
        layers = [x for x in self.manifest(self.version()).changes if x.seq > then.last]
        return self._live(layers).drop("bucket", "reject_reason")

    def changes(self, since: str | None) -> DataFrame | None:
        """(document_id) replaced or deleted after ``since``, or None where all may have changed: after a rebuild, or
        where that version is unknown."""
        now = self.manifest(self.version())
        if since is None or f"{since}.json" not in self._list("log") or (then := self.manifest(since)).epoch != now.epoch:
            return None
        if now.changes[0].seq > then.last + 1:  # older changes are forgotten
            return None
        rows = self.spark.createDataFrame([], "document_id string")
        for x in now.changes:
            if x.seq > then.last:
                rows = rows.unionByName(self._layer(x).select(F.col("document_id").cast("string").alias("document_id")))
        return rows.distinct()

    # writing

    def _bucket(self, document_id: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(document_id.cast("string")), F.lit(buckets)).cast("int")

    def _put(self, rows: DataFrame, buckets: int, gone: bool = False) -> tuple[Layer, dict]:
        """A layer of these rows, written in one pass that also counts and measures them."""
        rejected = F.col("reject_reason").isNotNull() if "reject_reason" in rows.columns else F.lit(False)
        embedded = "embedding" in rows.columns
        size = F.when(~rejected, F.coalesce(F.size("embedding"), F.lit(-1))) if embedded else F.lit(None).cast("int")
        model = F.when(~rejected, F.coalesce(F.col("embedding_model"), F.lit(""))) if "embedding_model" in rows.columns else F.lit(None).cast("string")
        seen = Observation()
        measured = rows.observe(seen, F.count(F.when(~rejected, 1)).alias("rows"), F.min(size).alias("least"), F.max(size).alias("most"), F.min(model).alias("model"), F.max(model).alias("other"))
        bucket = F.when(rejected, F.lit(REJECTED)).otherwise(self._bucket(F.col("document_id"), buckets))
        path = f"data/{uuid.uuid4().hex}"
        measured.withColumn("bucket", bucket).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{path}")
        found = sorted(int(x.removeprefix("bucket=")) for x in self._list(path) if x.startswith("bucket="))
        # a plan that is known to have no rows observes nothing
        stats = seen.get if found else {}
        return Layer(0, path, rows.schema.json(), int(stats.get("rows") or 0), [b for b in found if b != REJECTED], gone), {**stats, "embedded": embedded}

    def _commit(self, change) -> str:
        """The version that ``change`` makes of the current state (None where there is none)."""
        while True:
            now = self.current()
            state = change(now)
            made = replace(state, version=(now.version if now else 0) + 1)
            if self._create(f"log/{name_of(made.version)}.json", made.dump()):
                return name_of(made.version)

    def _empty(self) -> Manifest:
        return Manifest(0, uuid.uuid4().hex, self.buckets)

    @staticmethod
    def _agreed(state: Manifest, stats: dict) -> Manifest:
        """The state with the model and the size of vectors of what was written, unless these are not the store's."""
        if not stats.get("rows"):
            return state
        if stats["embedded"]:
            if stats["least"] < 1 or stats["least"] != stats["most"]:
                raise EmbeddingError("each chunk needs a vector, all of one size above zero")
            if state.size not in (None, stats["most"]):
                raise EmbeddingError(f"vectors have {stats['most']} numbers, the stored ones {state.size}")
            state = replace(state, size=stats["most"])
        if stats["model"] is not None:
            if stats["model"] != stats["other"] or not stats["model"]:
                raise EmbeddingError("all chunks need one embedding model")
            if state.model not in (None, stats["model"]):
                raise EmbeddingError(f"vectors are of the model {stats['model']}, the stored ones of {state.model}")
            state = replace(state, model=stats["model"])
        return state

    def _added(self, layer: Layer, stats: dict) -> str:
        def change(now: Manifest | None) -> Manifest:
            state = now or self._empty()
            if state.buckets != self.buckets:
                raise VectorStoreError("the table has another number of buckets")
            state = self._agreed(state, stats)
            own = replace(layer, seq=state.last + 1)
            return replace(state, last=own.seq, layers=[*state.layers, own], changes=[*state.changes, own][-MOST_CHANGES:])

        try:
            return self._commit(change)
        except Exception:
            self._delete(layer.path)
            raise

    def replace(self, fresh: DataFrame) -> str:
        """Exchange the documents in ``fresh``; the first call makes the table."""
        now = self.current()
        if now:
            self.buckets = now.buckets
        made = self._added(*self._put(fresh, self.buckets))
        self.compact(MOST_LAYERS)
        return made

    def delete(self, documents: DataFrame) -> str:
        """Documents (document_id) go, with all their chunks."""
        self.buckets = self.manifest(self.version()).buckets
        return self._added(*self._put(documents.select("document_id").distinct(), self.buckets, gone=True))

    def write(self, rows: DataFrame, after: str | None = None) -> str:
        """Drop all there is and build the table anew from ``rows``, provided that ``after`` is still the current version.
        Model and size of vectors may be others then."""
        layer, stats = self._put(rows, self.buckets)

        def change(now: Manifest | None) -> Manifest:
            if (name_of(now.version) if now else None) != after:
                raise VectorStoreError("another writer has changed the table; build again")
            own = replace(layer, seq=1)
            return replace(self._agreed(self._empty(), stats), last=1, layers=[own], changes=[own])

        try:
            return self._commit(change)
        except Exception:
            self._delete(layer.path)
            raise

    def rebuild(self, rows: DataFrame) -> str:
        """``write`` after whatever is current."""
        return self.write(rows, self.find_version())

    def compact(self, most: int = 1) -> str | None:
        """Write buckets with more than ``most`` layers anew as one; the new version, if there are any. Given up where another
        writer has done so meanwhile."""
        base = self.current()
        if base is None:
            return None
        depth: dict[int, int] = {}
        for x in base.layers:
            for b in x.buckets:
                depth[b] = depth.get(b, 0) + 1
        deep = sorted(b for b, n in depth.items() if n > most)
        if not deep:
            return None
        layer, _ = self._put(self._live(base.layers, deep).drop("bucket"), base.buckets)
        layer = replace(layer, seq=base.last)

        def left(layers: list[Layer]) -> list[Layer]:
            """Without the layers that are now one, in its buckets."""
            kept = [replace(x, buckets=[b for b in x.buckets if b not in deep or x.seq > base.last]) for x in layers]
            return [x for x in kept if x.buckets]

        class Overtaken(Exception):
            pass

        def change(now: Manifest | None) -> Manifest:
            of = lambda state: {(x.path, b) for x in state.layers for b in x.buckets if b in deep and x.seq <= base.last}
            if now is None or now.epoch != base.epoch or of(now) != of(base):
                raise Overtaken
            return replace(now, layers=[*left(now.layers), layer] if layer.buckets else left(now.layers))

        try:
            return self._commit(change)
        except Overtaken:
            self._delete(layer.path)
            return None

    def clean(self, keep: int = 2) -> list[str]:
        """Delete all but the ``keep`` newest versions, and the layers that only these knew; the names of those that went.
        Layers that no version knows are left to ``sweep``."""
        current = self.version()
        names = [x.removesuffix(".json") for x in self._list("log") if x.endswith(".json")]
        names = [x for x in names if x <= current]
        gone, kept = names[: -max(1, keep)], names[-max(1, keep) :]
        oldest = self.manifest(kept[0])
        of = lambda x: {y.path for y in [*x.layers, *(c for c in x.changes if x.epoch != oldest.epoch or c.seq > oldest.last)]}
        needed = {p for v in kept for p in of(self.manifest(v))}
        known = {y.path for v in gone for x in [self.manifest(v)] for y in [*x.layers, *x.changes]}
        for name in gone:
            self._delete(f"log/{name}.json")
        for path in known - needed:
            self._delete(path)
        return gone[::-1]

    def sweep(self) -> list[str]:
        """Delete layers that no version knows, which failed writers have left. Only while nobody writes."""
        known = {y.path for v in self._list("log") for x in [self.manifest(v.removesuffix(".json"))] for y in [*x.layers, *x.changes]}
        lost = [p for x in self._list("data") if (p := f"data/{x}") not in known]
        for path in lost:
            self._delete(path)
        return lost
