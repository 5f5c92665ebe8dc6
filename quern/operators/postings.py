"""An inverted index that outlives a search: postings of the chunk table's documents, kept and refreshed.

A segment numbers its documents by id in blocks of ``BLOCK`` and has a row for each token and block: the documents' places
in the block, ascending, with their counts and lengths, the greatest count and the least length. Places are whole numbers
that Parquet packs as differences (DELTA_BINARY_PACKED). Rows lie in buckets of their token, sorted by it, so a search reads
the buckets of its tokens and no text.

A refresh writes a segment of the documents that changed since the version that the index is of, and a table of the places
in older segments that these leave; df, document count and mean length follow. Many segments become one by a rebuild.

A search is exact. The greatest count and the least length bound what a token can add to a document of a block. Of each
question the blocks with the highest bounds, ``FIRST`` of them, are scored; the k-th best score so found is the least that
counts, and only blocks whose bounds reach it are scored, too.

What is shuffled are texts' tokens by block when the index is built, and lists by block when it is searched: counts of a
document, and pairs of questions and documents, which a common word makes of each two, come up and go within a task.

Results equal those of ``lexical.bm25`` over the same rows: statistics count rows, null texts are rows without tokens.
Rows of one id, which that operator adds up, are told apart here: ids must be distinct.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from ..errors import VectorStoreError
from ..functions.text import lexical_tokens
from ..sources.log import Versioned, name_of
from .lexical import BROADCAST_TOKENS, idf, question_tokens, ranked, tasks_for

BLOCK_BITS, BUCKETS, FIRST, MOST_SEGMENTS = 10, 64, 4, 8
#: Blocks of documents that a task makes lists of.
BLOCKS = 4
#: Below so many blocks for each of the first, bounds cost more than they save.
WORTH = 64
#: Places that documents have left, up to so many blocks' lists (some 100 MB), are broadcast.
BROADCAST_BLOCKS = 100_000
DELTA = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#slots.list.element": "false"}


@dataclass(frozen=True)
class Segment:
    seq: int
    path: str
    docs: str
    n_docs: int
    n_tokens: int
    buckets: list[int]


@dataclass(frozen=True)
class State:
    """Segments, the places that no longer count, and what of the source the index is of."""

    version: int
    source: str | None
    segments: list[Segment] = field(default_factory=list)
    #: Folder of (seq, block, gone), its number of rows, and what these documents had.
    dead: str | None = None
    dead_blocks: int = 0
    dead_docs: int = 0
    dead_tokens: int = 0

    @property
    def n_docs(self) -> int:
        return sum(s.n_docs for s in self.segments) - self.dead_docs

    @property
    def average(self) -> float:
        return (sum(s.n_tokens for s in self.segments) - self.dead_tokens) / self.n_docs if self.n_docs else 0.0


def _bucket(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


class PostingIndex(Versioned):
    """Documents are (id, text[, document_id][, owner]): an id is any type that can be ordered, replaced are whole documents
    of a document_id (the id itself where there is none)."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root)

    def state(self) -> State:
        if (found := self.find_version()) is None:
            raise VectorStoreError("nothing is indexed yet")
        held = json.loads(self._read(f"log/{found}.json"))
        return State(**{**held, "segments": [Segment(**s) for s in held["segments"]]})

    def _commit(self, state: State, base: int) -> State:
        made = replace(state, version=base + 1)
        if not self._create(f"log/{name_of(made.version)}.json", json.dumps(asdict(made))):
            raise VectorStoreError("another writer has changed the index; refresh again")
        return made

    # writing

    def _segment(self, docs: DataFrame, seq: int) -> Segment:
        """Number the documents, write them, and write their postings from what was written."""
        key = uuid.uuid4().hex
        owner = F.col("owner") if "owner" in docs.columns else F.lit(None)
        document = F.col("document_id") if "document_id" in docs.columns else F.col("id")
        rows = docs.select("id", document.cast("string").alias("document_id"), owner.cast("string").alias("owner"), lexical_tokens(F.col("text")).alias("ts"))
        place = F.monotonically_increasing_id()
        numbered = rows.repartitionByRange("id").sortWithinPartitions("id").withColumn("place", place)
        block, slot = F.shiftright("place", BLOCK_BITS), F.col("place").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int")
        draft = f"{self.root}/drafts/{key}"
        numbered.select(block.alias("block"), slot.alias("slot"), "id", "document_id", "owner", F.size("ts").alias("dl"), "ts").write.parquet(draft)
        held = self.spark.read.schema(numbered.select(block.alias("block"), slot.alias("slot"), "id", "document_id", "owner", F.size("ts").alias("dl"), "ts").schema).parquet(draft)
        names = held.drop("ts")
        names.write.parquet(f"{self.root}/docs/{key}")
        names_read = self.spark.read.schema(names.schema).parquet(f"{self.root}/docs/{key}")
        # dealt by block once: counts of documents and lists of blocks then need no further shuffle
        tasks = max(self.spark.sparkContext.defaultParallelism, math.ceil(names_read.count() / (BLOCKS << BLOCK_BITS)))
        dealt = held.select("block", "slot", "dl", "ts").repartition(tasks, "block")
        terms = dealt.select("block", "slot", "dl", F.explode("ts").alias("token")).groupBy("token", "block", "slot", "dl").agg(F.count("*").cast("int").alias("tf"))
        entries = F.array_sort(F.collect_list(F.struct("slot", "tf", "dl")))
        lists = terms.groupBy("token", "block").agg(entries.alias("e"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl"))
        postings = lists.select("token", "block", F.size("e").alias("n"), "max_tf", "min_dl", F.col("e.slot").alias("slots"), F.col("e.tf").alias("tfs"), F.col("e.dl").alias("dls"), _bucket(F.col("token")).alias("bucket"))
        path = f"postings/{key}"
        postings.hint("rebalance", "bucket").sortWithinPartitions("bucket", "token", "block").write.options(**DELTA).partitionBy("bucket").parquet(f"{self.root}/{path}")
        stats = names_read.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
        self._delete(f"drafts/{key}")
        buckets = [int(x.removeprefix("bucket=")) for x in self._list(path) if x.startswith("bucket=")]
        kept = json.dumps({"docs": names.schema.jsonValue(), "postings": postings.drop("bucket").schema.jsonValue(), "path": f"docs/{key}"})
        return Segment(seq, path, kept, stats.n, stats.dl, buckets)

    def build(self, docs: DataFrame, source: str | None = None) -> State:
        """Index all of ``docs``, whatever was indexed before; ``source`` names what they are."""
        base = self.find_version()
        return self._commit(State(0, source, [self._segment(docs, 1)]), int(base[1:]) if base else 0)

    def update(self, fresh: DataFrame, changed: DataFrame, source: str | None = None) -> State:
        """Exchange the documents (document_id) in ``changed`` by what ``fresh`` has of them."""
        state = self.state()
        seq = max(s.seq for s in state.segments) + 1
        ids = changed.select(F.col("document_id").cast("string").alias("document_id")).distinct()
        live = self._docs(state)
        left = live.join(ids, "document_id", "left_semi").select("seq", "block", "slot", "dl")
        if state.dead:
            left = left.unionByName(self._dead(state).select("seq", "block", F.explode("gone").alias("slot"), F.lit(0).alias("dl")))
        path = f"dead/{uuid.uuid4().hex}"
        left.groupBy("seq", "block").agg(F.array_sort(F.collect_list("slot")).alias("gone"), F.sum("dl").cast("bigint").alias("tokens")).write.parquet(f"{self.root}/{path}")
        own = self._segment(fresh, seq)
        told = self.spark.read.schema("seq int, block bigint, gone array<int>, tokens bigint").parquet(f"{self.root}/{path}").agg(F.count("*").alias("n"), F.sum(F.size("gone")).alias("docs"), F.sum("tokens").alias("tokens")).first()
        made = State(0, source, [*state.segments, own], path, told.n, told.docs or 0, state.dead_tokens + (told.tokens or 0))
        return self._commit(made, state.version)

    def sync(self, store, docs: Callable[[DataFrame], DataFrame]) -> State:
        """Bring the index to the store's current version: nothing to do, the documents that changed, or all. ``docs`` makes
        documents of the store's rows."""
        version = store.version()
        state = self.state() if self.find_version() else None
        if state and state.source == version:
            return state
        changed = store.changes(state.source) if state else None
        if changed is None or len(state.segments) >= MOST_SEGMENTS:
            return self.build(docs(store.read(version)), version)
        # what a later writer may add meanwhile has a later version and comes with the next refresh
        return self.update(docs(store.fresh(state.source)), changed, version)

    def clean(self) -> list[str]:
        """Delete all but the newest version, and the folders that only older ones knew."""
        now = self.state()
        of = lambda s: {p for x in s.segments for p in (x.path, json.loads(x.docs)["path"])} | {s.dead}
        gone = [x for x in self._list("log") if x.endswith(".json") and x < f"{name_of(now.version)}.json"]
        for name in gone:
            held = json.loads(self._read(f"log/{name}"))
            for path in of(State(**{**held, "segments": [Segment(**s) for s in held["segments"]]})) - of(now):
                self._delete(path)
            self._delete(f"log/{name}")
        return gone

    # reading

    def _dead(self, state: State) -> DataFrame:
        return self.spark.read.schema("seq int, block bigint, gone array<int>").parquet(f"{self.root}/{state.dead}")

    def _without_dead(self, rows: DataFrame, state: State) -> DataFrame:
        """``rows`` of (seq, block, ...) with ``gone``, null where all places count."""
        if not state.dead:
            return rows.withColumn("gone", F.lit(None).cast("array<int>"))
        dead = self._dead(state)
        return rows.join(F.broadcast(dead) if state.dead_blocks <= BROADCAST_BLOCKS else dead, ["seq", "block"], "left")

    def _docs(self, state: State) -> DataFrame:
        """(seq, block, slot, id, document_id, owner, dl) that count."""
        parts = []
        for s in state.segments:
            kept = json.loads(s.docs)
            parts.append(self.spark.read.schema(StructType.fromJson(kept["docs"])).parquet(f"{self.root}/{kept['path']}").withColumn("seq", F.lit(s.seq)))
        rows = parts[0]
        for x in parts[1:]:
            rows = rows.unionByName(x)
        kept = self._without_dead(rows, state)
        return kept.where(F.col("gone").isNull() | ~F.array_contains("gone", F.col("slot"))).drop("gone")

    def _postings(self, state: State, buckets: list[int]) -> DataFrame:
        """(seq, token, block, n, max_tf, min_dl, slots, tfs, dls) in some buckets."""
        parts = []
        for s in state.segments:
            kinds = StructType.fromJson(json.loads(s.docs)["postings"]).add("bucket", IntegerType())
            rows = self.spark.read.schema(kinds).parquet(f"{self.root}/{s.path}").where(F.col("bucket").isin([b for b in buckets if b in s.buckets]))
            parts.append(rows.drop("bucket").withColumn("seq", F.lit(s.seq)))
        rows = parts[0]
        for x in parts[1:]:
            rows = rows.unionByName(x)
        return rows

    def search(self, questions: DataFrame, top_k: int = 10, k1: float = 0.9, b: float = 0.4, prune: bool = True) -> DataFrame:
        """(query_id, id, score, rank) as ``lexical.bm25`` ranks; with a column ``owner`` in ``questions``, as
        ``lexical.bm25_scoped``. Statistics are those of all that is indexed."""
        state = self.state()
        asked = question_tokens(questions)
        # one pass over the questions tells their number of tokens and the buckets to read, of which there are few
        told = asked.agg(F.count("*").alias("n"), F.count_distinct("query_id").alias("queries"), F.collect_set(_bucket(F.col("token"))).alias("buckets")).first()
        near = F.broadcast if told.n <= BROADCAST_TOKENS else lambda df: df
        found = self._postings(state, told.buckets).join(near(asked.select("token").distinct()), "token")
        if state.dead:
            whole = F.arrays_zip("slots", "tfs", "dls")
            kept = F.when(F.col("gone").isNull(), whole).otherwise(F.filter(whole, lambda x: ~F.array_contains("gone", x["slots"])))
            found = self._without_dead(found, state).withColumn("e", kept).withColumns({"n": F.size("e"), **{c: F.col(f"e.{c}") for c in ("slots", "tfs", "dls")}}).where("n > 0")
        frequency = found.groupBy("token").agg(F.sum("n").alias("df"))
        tasks = tasks_for(questions, state.n_docs, told.queries)
        # dealt by block once, whatever the segment, which may be a constant: what a block's documents score needs no
        # further shuffle
        found = found.select("token", "seq", "block", "max_tf", "min_dl", "slots", "tfs", "dls").repartition(tasks, "block")
        terms = near(frequency.join(near(asked), "token").select("token", "query_id", "qtf", "pos", idf(F.lit(float(state.n_docs)), F.col("df")).alias("idf")))
        average = F.lit(state.average)

        def weight(tf: Column, dl: Column) -> Column:
            return F.col("qtf") * F.col("idf") * tf * F.lit(k1 + 1) / (tf + F.lit(k1) * (F.lit(1 - b) + F.lit(b) * dl / average))

        def scored(rows: DataFrame) -> DataFrame:
            """(query_id, seq, block, slot, score, pos) of (query_id, token, idf, ..., slots, tfs, dls)."""
            each = rows.select("query_id", "seq", "block", "qtf", "idf", "pos", F.explode(F.arrays_zip("slots", "tfs", "dls")).alias("x"))
            own = weight(F.col("x.tfs"), F.col("x.dls"))
            return each.groupBy("query_id", "seq", "block", F.col("x.slots").alias("slot")).agg(F.round(F.sum(own), 9).alias("score"), F.min("pos").alias("pos"))

        def within(wanted: DataFrame) -> DataFrame:
            """What is found of each question in its blocks of ``wanted``."""
            own = wanted.repartition(tasks, "block").groupBy("block").agg(F.collect_list(F.struct("seq", "query_id")).alias("wanted_by"))
            return found.join(own, "block").join(terms, "token").where(F.array_contains("wanted_by", F.struct("seq", "query_id")))

        matched = found.join(terms, "token")
        scoped = "owner" in questions.columns
        place = ["seq", "block", "slot"]
        docs = self._docs(state).select(*place, "id", *(["owner"] if scoped else []))
        if scoped:
            wanted = questions.select("query_id", F.col("owner").cast("string").alias("_scope"))
            own = scored(matched).join(docs, place).join(wanted, "query_id")
            return ranked(own.where(F.col("_scope").isNull() | (F.col("_scope") == F.col("owner"))), top_k)
        blocks = ["query_id", "seq", "block"]
        if prune and state.n_docs > WORTH * FIRST << BLOCK_BITS:
            bounds = matched.groupBy(*blocks).agg(F.sum(weight(F.col("max_tf"), F.col("min_dl"))).alias("bound"))
            order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "seq", "block")
            bounds = bounds.withColumn("place", F.row_number().over(order))
            first = scored(within(bounds.where(F.col("place") <= FIRST)))
            best = Window.partitionBy("query_id").orderBy(F.desc("score"))
            least = first.withColumn("r", F.row_number().over(best)).where(F.col("r") == top_k).select("query_id", F.col("score").alias("least"))
            # bounds and scores are rounded sums: what differs in the last digits still counts
            reaching = bounds.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") >= F.col("least") - 1e-6)).select(*blocks)
            matched = within(reaching)
        # documents beyond the k best scores go before their ids are looked up; ties stay
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
        close = scored(matched).withColumn("r", F.rank().over(order)).where(F.col("r") <= top_k).drop("r")
        return ranked(close.join(docs, place), top_k)
