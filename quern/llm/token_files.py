"""Token ids in files: one long id array for each run of documents, its boundaries in Elias-Fano code.

Documents are encoded where they are read, so only ids cross the network. They are dealt by ranges of doc_id and sorted,
so each range is a run of documents in ascending order. A file holds consecutive documents of a range, up to
``SHARD_IDS`` ids, and is one row of a Parquet table in the shared folder, so Spark commits files as a whole and a lost
executor leaves none behind. Its fields:

    shard, part                 the range and the file's place in it
    n_docs, n_ids, n_null       counts; a file's place in the whole follows from n_ids of the files before it
    low_bits                    l = floor(log2(n_ids / n_docs)), bits of a boundary kept as they are
    low                         the l low bits of each boundary (where a document's ids end), packed
    high                        the rest in unary: bit (boundary >> l) + k is set for document k
    select                      the place of every ``SELECT``-th set bit of ``high``, 32 bits each
    doc_ids                     64 bits each, without those of the first n_null documents, which have none
    ids, width                  ``width`` bytes each: 2 where all ids fit, else 4

Boundaries take l + 2 bits each, with no table of 64-bit offsets; ``select_end(k)`` starts at a sample and reads a few
bytes. A task has a bounded cache of encoded pre-tokens. Ranges, ``RANGES`` at most, lie between quantiles of a sample
of ``SAMPLED`` doc_ids for each; where one doc_id, or its lack, fills several, they part by a hash of the text. So
neither a far doc_id nor many rows of one doc_id, or of none, fill a single task, and what the driver holds is bounded.

Cases: null or empty text has the end id only; null doc_ids come first; ties (repeated doc_ids) are in the order of
a hash of their texts; the library's added tokens are found in texts as it finds them; an empty table gives no file.
Only doc_id and text are read.
"""

from __future__ import annotations

import bisect
import gc
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, table, texts_of, written
from .pretokens import Pieces, cutter, plain

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
SHARD_DOCS, SHARD_IDS, SELECT, CACHE = 1024, 2 << 20, 64, 750_000
RANGES, SAMPLED = 16_384, 32
#: Up to so many files (1 MB of places), a broadcast brings them their starts; beyond it, a shuffle.
BROADCAST_FILES = 40_000
SCHEMA = "shard int, part int, n_docs bigint, n_ids bigint, n_null bigint, low_bits int, low binary, high binary, select_ binary, doc_ids binary, ids binary, width int"
_loaded: dict[str, object] = {}


class Encoder:
    """Ids by the tokenizers library, as 16-bit numbers where the vocabulary allows, else 32.

    Python sees each distinct piece of a batch once, and the library each pre-token of a new piece once while its ids
    stay in the cache, which holds up to twice ``CACHE`` of them. Texts that cannot be cut, or that hold an added token of the library, go to it whole.
    """

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cut = cutter(pattern)
        # pieces used since the cache was last full, and those before: what is used again moves on, the rest goes
        self.known: dict[int, bytes] = {}
        self.older: dict[int, bytes] = {}
        vocabulary = self.library.get_vocab()
        self.kind = np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32
        self.blank = np.zeros(max(vocabulary.values()) + 1, bool)
        self.blank[[k for t, k in vocabulary.items() if t[0] == "\u0120"]] = True  # how byte-level vocabularies write a blank
        self.line = vocabulary["\u010a"]  # and a line feed

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.kind) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _rows(self, keys: list[int], words: list[bytes], joint: bytes, lead: bytes = b"") -> None:
        """Words of letters, encoded in rows: with blanks before them they part by themselves, others by line feeds."""
        size = np.dtype(self.kind).itemsize
        rows = [words[at : at + 200] for at in range(0, len(words), 200)]
        at = 0
        for some, ids in zip(rows, self._library([joint.join(x).decode() for x in rows]), strict=True):
            cuts = (np.flatnonzero(ids == self.line) if joint else np.flatnonzero(self.blank[ids])) * size
            starts = [0, *(cuts + size).tolist()] if joint else cuts.tolist()
            ends = [*(cuts.tolist() if joint else starts[1:]), len(ids) * size]
            if len(starts) != len(some):
                raise ValueError("the tokenizer does not cut where the pattern does")
            data = ids.tobytes()
            made = [data[a:b] for a, b in zip(starts, ends, strict=True)]
            self.known.update(zip(keys[at : at + len(some)], [lead + x for x in made] if lead else made, strict=True))
            at += len(some)

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of single pre-tokens. Those without white space but a first blank are encoded in rows between line feeds; where
        the tokenizer joins a line feed to what stands before it, as the numbers tell, a row is encoded word by word."""
        alone = [w for w in words if (x := w.removeprefix(" ")).split() != [x]]
        found = dict(zip(alone, (x.tobytes() for x in self._library(alone)), strict=True))
        joint = [w for w in words if w not in found]
        rows = [joint[at : at + 200] for at in range(0, len(joint), 200)]
        size = np.dtype(self.kind).itemsize
        for some, ids in zip(rows, self._library(["\n".join(x) for x in rows]), strict=True):
            cuts = (np.flatnonzero(ids == self.line) * size).tolist()
            if len(cuts) == len(some) - 1:
                data = ids.tobytes()
                found.update(zip(some, map(data.__getitem__, map(slice, [0, *(c + size for c in cuts)], [*cuts, len(data)])), strict=True))
            else:
                found.update(zip(some, (x.tobytes() for x in self._library(some)), strict=True))
        return found

    def _learn(self, names: list[int], cut: Pieces, fresh: np.ndarray) -> None:
        letters, apart, raw = cut.letters(fresh), cut.apart[fresh], cut.raw
        feed = np.array([self.line], self.kind).tobytes()
        left = np.ones(len(fresh), bool)
        for chosen, back, joint, lead in ((letters & (apart == 32), 1, b"", b""), (letters & np.isin(apart, (0, 255)), 0, b"\n", b""), (letters & (apart == 10), 0, b"\n", feed)):
            own = fresh[chosen]
            left &= ~chosen
            self._rows([names[k] for k in own.tolist()], [raw[s:e] for s, e in zip((cut.start[own] - back).tolist(), cut.end[own].tolist(), strict=True)], joint, lead)
        rest = fresh[left].tolist()
        parts = list(map(self.cut, cut.texts(rest)))
        ids = self._words(list({w for p in parts for w in p}))
        for k, p in zip(rest, parts, strict=True):
            self.known[names[k]] = b"".join(map(ids.__getitem__, p))

    def _cut(self, texts: list[str]) -> list[bytes]:
        cut = Pieces(texts)
        names = cut.keys.tolist()
        found = list(map(self.known.get, names))
        fresh = [k for k, x in enumerate(found) if x is None]
        if fresh and self.older:
            again = {k: x for k in fresh if (x := self.older.get(names[k])) is not None}
            for k, x in again.items():
                found[k] = self.known[names[k]] = x
            fresh = [k for k in fresh if k not in again]
        if fresh:
            self._learn(names, cut, np.array(fresh))
            for k in fresh:
                found[k] = self.known[names[k]]
        size = np.dtype(self.kind).itemsize
        flat = np.frombuffer(b"".join(found), self.kind)
        lengths = np.fromiter(map(len, found), np.int64, len(found)) // size
        own = lengths[cut.place]
        total = np.append(0, np.cumsum(own))
        ids = flat[np.repeat((np.cumsum(lengths) - lengths)[cut.place] - total[:-1], own) + np.arange(total[-1])].tobytes()
        bounds = (total[cut.bounds] * size).tolist()
        if len(self.known) > CACHE:
            self.older, self.known = self.known, {}
        return [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        able = [plain(t) and not any(x in t for x in self.added) for t in texts]
        quick = iter(self._cut([t for t, ok in zip(texts, able, strict=True) if ok]) if any(able) else ())
        slow = iter(self._library([t for t, ok in zip(texts, able, strict=True) if not ok]))
        return [next(quick) if ok else next(slow).tobytes() for ok in able]


def packed_bits(values: np.ndarray, width: int) -> bytes:
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpacked_bits(data: bytes, width: int, n: int) -> np.ndarray:
    if not width:
        return np.zeros(n, np.uint64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width).astype(np.uint64)
    return (bits << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


class Boundaries:
    """A nondecreasing sequence in Elias-Fano code with select."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, select: bytes):
        self.n, self.l, self.low, self.high, self.samples = n, low_bits, low, high, np.frombuffer(select, np.uint32)

    @classmethod
    def of(cls, ends: np.ndarray) -> Boundaries:
        n, most = len(ends), int(ends[-1]) if len(ends) else 0
        l = max(0, (most // max(n, 1)).bit_length() - 1)
        ends = ends.astype(np.uint64)
        places = (ends >> np.uint64(l)).astype(np.int64) + np.arange(n)
        bits = np.zeros((int(places[-1]) + 1) if n else 0, np.uint8)
        bits[places] = 1
        return cls(n, l, packed_bits(ends & np.uint64((1 << l) - 1), l), np.packbits(bits, bitorder="little").tobytes(), places[::SELECT].astype(np.uint32).tobytes())

    def select_end(self, k: int) -> int:
        """Where document k's ids end."""
        at, left = int(self.samples[k // SELECT]), k % SELECT
        byte = at >> 3
        word = self.high[byte] >> (at & 7) << (at & 7)
        while (here := word.bit_count()) <= left:
            left -= here
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        high = (byte << 3) + (word & -word).bit_length() - 1 - k
        if not self.l:
            return high
        first = k * self.l
        span = int.from_bytes(self.low[first >> 3 : (first + self.l + 7) >> 3], "little")
        return (high << self.l) | ((span >> (first & 7)) & ((1 << self.l) - 1))

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n]
        return (((places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.l)) | unpacked_bits(self.low, self.l, self.n)).astype(np.int64)


def _file(shard: int, part: int, width: int, doc_ids: list[int | None], ids: list[bytes]) -> tuple:
    lengths = np.array([len(x) // width for x in ids], np.int64)
    flat = np.frombuffer(b"".join(ids), f"u{width}")
    ends = Boundaries.of(np.cumsum(lengths))
    known = [d for d in doc_ids if d is not None]
    return shard, part, len(ids), len(flat), len(ids) - len(known), ends.l, ends.low, ends.high, ends.samples.tobytes(), np.array(known, np.int64).tobytes(), flat.astype(f"<u{width}").tobytes(), width


#: Before all doc_ids; and before all hashes.
NONE, FIRST = (False, 0), -(1 << 63)


def ranges_of(docs: DataFrame, n: int) -> list[tuple]:
    """Where ranges of (doc_id, tie) end, as ((has one, doc_id), tie) in ascending order: quantiles of a sample."""
    ranges = min(RANGES, -(-n // SHARD_DOCS))
    if ranges < 2:
        return []
    some = docs.sample(min(1.0, SAMPLED * ranges / n), seed=1)

    def quantiles(keys: list[tuple]) -> list[tuple]:
        keys.sort()
        return [keys[k * len(keys) // ranges] for k in range(1, ranges)] if keys else []

    key = lambda d: NONE if d is None else (True, d)
    found = quantiles([(key(r.doc_id), FIRST) for r in some.select("doc_id").collect()])
    if len(set(found)) < len(found):  # one doc_id fills several ranges
        found = quantiles([(key(r.doc_id), r.tie) for r in some.select("doc_id", "tie").collect()])
    return sorted(set(found))


def write_files(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, end_id: int = END_ID, into: str | None = None) -> DataFrame:
    """Encode all documents and write the files to the folder ``into``; the table of files, read again.

    Without ``into`` the files lie in the shared folder and go when the application ends.
    """
    spark, path = prepare(docs.sparkSession), path or public_tokenizers.path(TOKENIZER)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"))
    bounds = ranges_of(docs, docs.count())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # nothing here makes cycles, and the collector walks all the lists
        if path not in _loaded:
            _loaded[path] = Encoder(path, pattern)
        end = np.array([end_id], _loaded[path].kind).tobytes()
        width = np.int8(_loaded[path].kind(0).itemsize)
        for b in batches:
            keys = zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)
            shard = [bisect.bisect_right(bounds, (NONE if d is None else (True, d), t)) for d, t in keys]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), b.column(0), b.column(2), pa.array([x + end for x in _loaded[path](texts_of(b.column(1)))], pa.binary()), pa.array(np.full(b.num_rows, width))], names=["shard", "doc_id", "tie", "ids", "width"])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, part, size, width = None, 0, 0, 0
        doc_ids: list[int | None] = []
        ids: list[bytes] = []

        def done():
            return pa.RecordBatch.from_pylist([dict(zip(names, _file(shard, part, width, doc_ids, ids), strict=True))], schema=kinds)

        for b in batches:
            for s, d, x, w in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if ids and (s != shard or size >= SHARD_IDS):
                    yield done()
                    part, size, doc_ids, ids = part + 1 if s == shard else 0, 0, [], []
                shard, width = s, w
                doc_ids.append(d)
                ids.append(x)
                size += len(x) // w
        if ids:
            yield done()

    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = pa.schema([(x.split()[0], {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in SCHEMA.split(", ")])
    rows = docs.mapInArrow(encode, "shard int, doc_id bigint, tie bigint, ids binary, width byte")
    dealt = rows.repartition("shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "tie", "ids").drop("tie")
    made = dealt.mapInArrow(files, SCHEMA)
    if into is None:
        return written(made, "token-files")
    made.write.parquet(into)
    return spark.read.schema(made.schema).parquet(into)


def places(files: DataFrame) -> DataFrame:
    """(shard, part, start): the ids of all files before each. Shards, of which there are ``RANGES`` at most, are summed
    up first, so that no window holds more than those, or the files of one."""
    sizes = files.select("shard", "part", "n_ids")
    sofar = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("whole")).select("shard", F.sum("whole").over(sofar(Window.orderBy("shard"))).alias("before"))
    own = sizes.withColumn("own", F.sum("n_ids").over(sofar(Window.partitionBy("shard").orderBy("part"))))
    return own.join(F.broadcast(shards), "shard").select("shard", "part", (F.coalesce("before", F.lit(0)) + F.coalesce("own", F.lit(0))).alias("start"))


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files alone: its ids lie between two selects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                bounds = Boundaries(x["n_docs"], x["low_bits"], x["low"], x["high"], x["select_"])
                ends = np.fromiter(map(bounds.select_end, range(x["n_docs"])), np.int64, x["n_docs"])
                begins = np.append(0, ends[:-1])
                ids = np.frombuffer(x["ids"], f"<u{x['width']}").astype("<u4")
                known = np.append(np.zeros(x["n_null"], np.int64), np.frombuffer(x["doc_ids"], np.int64))
                sums = [zlib.crc32(ids[s:e]) for s, e in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(known, mask=np.arange(len(known)) < x["n_null"]), pa.array(begins + x["start"]), pa.array(ends - begins), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    starts = places(files)
    if files.count() <= BROADCAST_FILES:
        starts = F.broadcast(starts)
    return files.join(starts, ["shard", "part"]).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the files."""
    return read_files(write_files(table(spark, sf_dir, "documents")))
