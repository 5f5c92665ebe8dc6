"""Asking all documents about hashes, without a row for each hash.

Texts are dealt once into blocks of about ``BLOCK_BYTES`` by hash. A block sends the distinct keys that it asks about,
cut by key into buckets, as one binary row for each bucket; a bucket joins the rows of all blocks and answers each with
bits in the order of its keys. Blocks then go on with their texts, which the same exchange brings. A key that stands in
a third of all documents is one entry for each block, so no key makes a task large; blocks and buckets grow in number
with the bytes of text, not in size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

BLOCK_BYTES, BUCKET_BYTES = 8 << 20, 16 << 20


def spread(total: int, size: int, parts: int) -> int:
    """How many pieces of about ``size`` bytes; of a small input, smaller ones, so that each partition can have one."""
    return max(1, math.ceil(total / size), min(parts, math.ceil(total / (size // 8))))


def deal(docs: DataFrame, key: str = "doc_id") -> tuple[DataFrame, int]:
    """(key, text, block) dealt by block, and the number of buckets. Null texts are empty."""
    spark = prepare(docs.sparkSession)
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, buckets = spread(total, BLOCK_BYTES, parts), spread(total, BUCKET_BYTES, parts)
    parts = max(parts, blocks)
    text = F.coalesce("text", F.lit(""))
    dealt = docs.select(key, text.alias("text"), F.pmod(F.xxhash64(key, text), F.lit(blocks)).cast("int").alias("block")).repartition(parts, "block")
    return dealt, buckets


def in_order(group: pa.Table, key: str = "doc_id") -> pa.Table:
    """A block's rows by key and text. Where executors fetch from one another, each pass gets a block's rows in another
    order; passes that agree on places in a block need this one."""
    return group.take(pc.sort_indices(group, sort_keys=[(key, "ascending"), ("text", "ascending")]))


def cut(keys: np.ndarray, buckets: int) -> list[np.ndarray]:
    """For sorted keys: the places of each bucket's keys, in order."""
    of = (keys % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    return np.split(order, np.searchsorted(of[order], np.arange(1, buckets)))


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def flags_of(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def narrow(values: np.ndarray) -> bytes:
    """Whole numbers in 32 bits each where they fit, else in 64."""
    fits = not len(values) or (0 <= values.min() and values.max() < 1 << 32)
    return bytes([4 if fits else 8]) + values.astype(np.uint32 if fits else np.int64).tobytes()


def wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data[1:], np.uint32 if data[0] == 4 else np.int64).astype(np.int64)


def in_sorted(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def seen_twice(keys: list[np.ndarray], many: list[np.ndarray]) -> list[bytes]:
    """For each block's distinct keys: whether another block has the key, or ``many`` says so."""
    lengths = [len(x) for x in keys]
    joined = np.concatenate(keys)
    order = np.argsort(joined, kind="stable")
    edge = np.flatnonzero(np.append(True, joined[order][1:] != joined[order][:-1])) if len(joined) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(edge, len(joined)))
    out = np.zeros(len(joined), bool)
    if len(joined):
        out[order] = np.repeat((sizes > 1) | np.logical_or.reduceat(np.concatenate(many)[order], edge), sizes)
    return [bits(x) for x in np.split(out, np.cumsum(lengths)[:-1])]


def smaller_elsewhere(keys: list[np.ndarray], checks: list[np.ndarray], least: list[np.ndarray]) -> list[bytes]:
    """For each block's distinct (key, check), with the least id that the block has it in: whether another block has a smaller one."""
    lengths = [len(x) for x in keys]
    k, c, d = map(np.concatenate, (keys, checks, least))
    out = np.zeros(len(k), bool)
    if len(k):
        order = np.argsort(k, kind="stable")
        ks, cs = k[order], c[order]
        same = ks[1:] == ks[:-1]
        if (same & (cs[1:] != cs[:-1])).any():  # two contents share a key: tell them apart
            order = np.lexsort((c, k))
            ks, cs = k[order], c[order]
        edge = np.flatnonzero(np.append(True, (ks[1:] != ks[:-1]) | (cs[1:] != cs[:-1])))
        ds = d[order]
        out[order] = ds > np.repeat(np.minimum.reduceat(ds, edge), np.diff(np.append(edge, len(k))))
    return [bits(x) for x in np.split(out, np.cumsum(lengths)[:-1])]


def least_of(keys: np.ndarray, checks: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, check) by key, with their least id, and for each input its place among them."""
    if not len(keys):
        return keys, checks, ids, np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if (same & (checks[order][1:] != checks[order][:-1])).any():  # two contents share a key: tell them apart
        order = np.lexsort((checks, keys))
        same = (keys[order][1:] == keys[order][:-1]) & (checks[order][1:] == checks[order][:-1])
    edge = np.flatnonzero(np.append(True, ~same))
    place = np.empty(len(keys), np.int64)
    place[order] = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(keys))))
    return keys[order][edge], checks[order][edge], np.minimum.reduceat(ids[order], edge), place


def arrow(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({name: pa.array([r[k] for r in rows], kinds[kind]) for k, (name, kind) in enumerate(fields)})
