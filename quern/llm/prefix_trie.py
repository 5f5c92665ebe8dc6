"""A trie of conversation prefixes, by chained digests.

The digest of the empty sequence is SHA-256 of nothing; the digest of a longer one is SHA-256 of that of all its turns but
the last, and of the last turn's own digest (of its role's length, role and text). So equal prefixes, and with all
likelihood only those, have equal digests, and what is shuffled has 32 bytes for a turn instead of its text.

Every conversation explodes into all its prefixes (the empty one included), which group by depth and digest into the nodes,
with map-side counts and minima, so a first turn that a third of all conversations share is no hot key. Of the nodes with
one smallest member, which are a line downwards, running sums from the bottom up give each its part of the line; the
line's total is then exploded to all the nodes above it, the ancestors, whose digests are the smallest member's prefixes.
Each node reaches all its ancestors that way, and there are no more such rows than prefixes, where a row for each node and
ancestor would be the square of a long conversation's turns. Prefixes are dealt by conversation and ``BLOCK`` depths.

Where children ask for their parent's smallest member, parents with a ``HOT``th of all lines below them, fewer than
``HOT``, are broadcast and the others joined. The digest of the members that end at a node reads their ids in order: these
are dealt by ranges of (node, id), joined to texts of at most ``PIECE`` bytes, and hashed piece by piece, so that no task
holds a group.

Cases: rows of a null conv_id are in no conversation; null role or text is empty; turns are ordered by number, null first,
and of one number by the digests of role and text, so repeated rows are repeated turns; a conversation of no turns is a
member of the root alone; an empty table has no node, not even a root. A conversation's turns are streamed by one task, as
its chain is a sequence; texts are hashed where they are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, table, written

BLOCK, HOT, PIECE = 1024, 1000, 1 << 20
ROOT = hashlib.sha256(b"").digest()
PREFIXES = "conv_id bigint, depth int, digest binary, parent binary, chars bigint, ends boolean"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, leaf, chars): the digest of each turn's role and text, and the text's code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null")
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.unhex(F.sha2(named, 256)).alias("leaf"), F.length(text).cast("bigint").alias("chars"))


def numbered(own: DataFrame, most: int) -> DataFrame:
    """(conv_id, head): the first turns of each conversation, at most ``most`` of them."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "leaf")
    first = own.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most)
    return first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "leaf", "chars"))).alias("head"))


def prefixes(own: DataFrame, convs: DataFrame) -> DataFrame:
    """All prefixes of conversations: turns (conv_id, turn, leaf, chars) and (conv_id, skip, head), where a conversation is
    its head followed by its turns after the first ``skip``."""
    none = lambda kind: F.lit(None).cast(kind)
    # a row that opens each conversation, its head, its own turns
    opening = convs.select("conv_id", F.lit(0).alias("part"), none("bigint").alias("turn"), none("binary").alias("leaf"), F.col("skip").cast("bigint").alias("chars"))
    heads = convs.select("conv_id", F.explode("head").alias("x")).select("conv_id", F.lit(1).alias("part"), F.col("x.at").cast("bigint").alias("turn"), "x.leaf", "x.chars")
    rows = opening.unionByName(heads).unionByName(own.select("conv_id", F.lit(2).alias("part"), "turn", "leaf", "chars"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", F.col("turn").asc_nulls_first(), "leaf")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, skip, last = [], 0, None
        for b in batches:
            for conv, part, leaf, chars in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "leaf", "chars")), strict=True):
                if part == 0:
                    if last is not None:
                        held.append((*last, True))
                    last, skip = (conv, 0, ROOT, None, 0), chars
                elif part == 2 and skip:
                    skip -= 1
                else:
                    held.append((*last, False))
                    last = (conv, last[1] + 1, hashlib.sha256(last[2] + leaf).digest(), last[2], chars)
            if len(held) >= 10_000:
                yield made(held)
                held = []
        if last is not None:
            held.append((*last, True))
        if held:
            yield made(held)

    def made(held: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=["conv_id", "depth", "digest", "parent", "chars", "ends"])

    return dealt.mapInArrow(run, PREFIXES)


def member_hashes(ends: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of (digest, conv_id): the ids of a node, ascending and joined by commas, hashed."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, first, size, out = None, [], None, 0, []
        for b in batches:
            for digest, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if digest != node or size > PIECE:
                    if ids:
                        out.append((node, first, ",".join(ids)))
                    node, ids, first, size = digest, [], conv, 0
                ids.append(str(conv))
                size += len(ids[-1]) + 1
            if len(out) >= 1000:
                yield pieces(out)
                out = []
        if ids:
            out.append((node, first, ",".join(ids)))
        if out:
            yield pieces(out)

    def pieces(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)], names=["digest", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for b in batches:
            for digest, ids in zip(b.column("digest").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if digest != node:
                    if state is not None:
                        out.append((node, state.hexdigest()))
                    node, state = digest, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state is not None:
            out.append((node, state.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out])], names=["digest", "ends_sha256"])

    # by ranges of node and id, so that the members of one node can lie in many tasks
    dealt = ends.select("digest", "conv_id").repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    parts = dealt.mapInArrow(joined, "digest binary, first bigint, ids string")
    again = parts.repartition("digest").sortWithinPartitions("digest", "first")
    return again.mapInArrow(hashed, "digest binary, ends_sha256 string")


def trie(prefix_rows: DataFrame) -> DataFrame:
    """The nodes of prefixes, which ``prefixes`` made and which are written down: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    grouped = prefix_rows.groupBy("depth", "digest", "parent", "chars").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("ends").cast("bigint")).alias("n_ends"))
    # a node that all members end at has no children
    saved, leaf = (F.col("n_convs") - 1) * F.col("chars"), (F.col("n_convs") == F.col("n_ends")).cast("bigint")
    line = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    below = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nodes = written(
        grouped.select(
            "depth", "digest", "parent", "conv_id", "n_convs",
            F.sum(saved).over(below).alias("saved"),
            F.sum(leaf).over(below).alias("leaves"),
            F.lag("depth").over(line).isNotNull().cast("bigint").alias("goes_on"),
            F.lead("depth").over(line).isNull().alias("top"),
        ),
        "trie-nodes",
    )
    tops = nodes.where("top and depth > 0")
    block = lambda c: F.floor(c / BLOCK).cast("int")
    asked = tops.select("conv_id", F.col("depth").alias("top_depth"), "saved", "leaves", F.explode(F.sequence(F.lit(0), block(F.col("depth") - 1))).alias("block"))
    above = prefix_rows.select("conv_id", "depth", "digest", block(F.col("depth")).alias("block")).join(asked, ["conv_id", "block"]).where("depth < top_depth")
    lines = (F.col("depth") == F.col("top_depth") - 1).cast("bigint")
    brought = written(above.groupBy("digest").agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"), F.sum(lines).alias("lines")), "trie-sums")
    # fewer than HOT parents have more than a HOTth of all lines: these are broadcast
    bound = brought.agg(F.sum("lines") / HOT).scalar()
    wide = brought.where((F.col("lines") > 0) & (F.col("lines") > bound)).select(F.col("digest").alias("parent"))
    known = nodes.select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    hot = written(known.join(F.broadcast(wide), "parent"), "trie-hot")
    own = tops.select("digest", "parent")
    parents = own.join(F.broadcast(hot), "parent").unionByName(own.join(F.broadcast(hot.select("parent")), "parent", "left_anti").join(known, "parent"))
    ends = member_hashes(prefix_rows.where("ends"))
    joined = nodes.join(brought, "digest", "left").join(ends, "digest", "left").join(parents.select("digest", "parent_conv_id"), "digest", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return joined.select(
        "conv_id",
        F.col("depth").cast("bigint").alias("depth"),
        # within a line the parent has the same smallest member
        F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        (F.col("goes_on") + zero("lines")).alias("n_children"),
        (F.col("leaves") + zero("more_leaves")).alias("n_leaves"),
        (F.col("saved") + zero("more_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", nothing).alias("ends_sha256"),
    )


def as_they_are(conversations: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they stand."""
    prepare(conversations.sparkSession)
    own = turns(conversations)
    convs = own.select("conv_id").distinct().select("conv_id", F.lit(0).alias("skip"), F.array().cast("array<struct<at:int,leaf:binary,chars:bigint>>").alias("head"))
    return trie(written(prefixes(own, convs), "trie-prefixes"))


#: Conversations of a hundred share the beginning of the first, by up to five turns.
FAMILY, SHARED = 100, 6


def shared_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % SHARED).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """The prefixes of conversations whose first turns, as many as their id says, are those of their family's first."""
    own = turns(conversations)
    head = numbered(own.where(F.col("conv_id") % FAMILY == 0), SHARED - 1).select(F.col("conv_id").alias("first"), "head")
    ids = own.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"), shared_turns(F.col("conv_id")).alias("skip"))
    none = F.array().cast("array<struct<at:int,leaf:binary,chars:bigint>>")
    convs = ids.join(head, "first", "left").select("conv_id", "skip", F.coalesce(F.slice("head", F.lit(1), F.col("skip")), none).alias("head"))
    return prefixes(own, convs)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return trie(written(rebuilt(table(spark, sf_dir, "conversations")), "trie-prefixes"))


#: Over conversations; CRC-32 of decimal ids by its definition, bit by bit.
ORACLE_SQL = """WITH ids AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL),
skips AS (SELECT conv_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
  lambda a, b: list_reduce(list_concat([xor(a, b)], CAST(range(8) AS BIGINT[])), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295) % 6 AS h FROM ids),
own AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
taken AS (SELECT s.conv_id, 0 AS part, o.pos, o.role, o.text FROM skips s JOIN own o ON o.conv_id = s.conv_id - s.conv_id % 100 AND o.pos <= h
  UNION ALL SELECT o.conv_id, 1, o.pos, o.role, o.text FROM own o JOIN skips s ON o.conv_id = s.conv_id AND o.pos > h),
made AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY part, pos) AS turns FROM taken GROUP BY conv_id),
whole AS (SELECT conv_id, coalesce(turns, []) AS turns FROM ids LEFT JOIN made USING (conv_id)),
prefixes AS (SELECT conv_id, d, turns[1:d] AS p, d = len(turns) AS ends FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM whole)),
nodes AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends FROM prefixes GROUP BY d, p),
kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
told AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n - 1) * length(p[d].text) END AS saved FROM nodes n LEFT JOIN kids USING (d, p)),
ups AS (SELECT p[1:u] AS p, u AS d, saved, n_children FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM told)),
sums AS (SELECT d, p, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM ups GROUP BY d, p)
SELECT t.conv_id, t.d AS depth, a.conv_id AS parent_conv_id, t.n AS n_convs, t.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, t.ends AS ends_sha256
FROM told t JOIN sums s USING (d, p) LEFT JOIN nodes a ON a.d = t.d - 1 AND a.p = t.p[1:t.d - 1]"""
