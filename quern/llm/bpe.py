"""Byte-level BPE by a global shuffle of distinct words.

Texts are dealt once into blocks of about ``BLOCK_BYTES``. Each block lists its distinct pre-tokens; the lists, cut by
word hash and compressed, go to the words' buckets, where each distinct word is encoded once and the ids go back to
the blocks that asked. A block then puts its texts' ids together by position. Decoding looks each id of a text up in the
token-byte table. What crosses the network besides the text follows the number of distinct words of a block, not of
tokens.

Blocks are drawn by hash and so have like sizes; a bucket holds the distinct words of about ``BUCKET_BYTES`` of text, so
buckets grow in number with the corpus, not in size.

Cases: null or empty text has no tokens; repeated rows give repeated results; any text, however long, is encoded
whole; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import spread
from .common import calm, prepare, table, texts_of
from .pretokens import Pieces, cutter, distinct, plain

RANKS = "byte_bpe_50k.tiktoken"
BLOCK_BYTES, BUCKET_BYTES = 10 << 20, 48 << 20
#: A pattern that takes a pre-token as it is.
WHOLE = r"(?s:.+)"
#: Pieces of text that are put together at once: numpy holds 8 bytes for each of their ids.
TOGETHER = 1 << 17
_loaded: dict[tuple[str, str], object] = {}


def ranks_of(path: str) -> dict[bytes, int]:
    if ("ranks", path) not in _loaded:
        with open(path, "rb") as f:
            _loaded["ranks", path] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return _loaded["ranks", path]


def encoding_of(path: str, pattern: str):
    if (path, pattern) not in _loaded:
        import tiktoken

        _loaded[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks_of(path), special_tokens={})
    return _loaded[path, pattern]


def token_bytes(path: str) -> dict[int, bytes]:
    """The token-byte table."""
    if ("bytes", path) not in _loaded:
        _loaded["bytes", path] = {v: k for k, v in ranks_of(path).items()}
    return _loaded["bytes", path]


LEVEL = 6


def _packed(lengths: list[int], data: bytes) -> bytes:
    """Lengths, in 8 bits each if they fit, and data, compressed one by one."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    fits = max(lengths) < 256
    head = compress(np.array(lengths, np.uint8 if fits else np.uint32).tobytes())
    return bytes([fits]) + len(head).to_bytes(4, "little") + head + compress(data)


def _unpacked(packed: bytes) -> tuple[np.ndarray, bytes]:
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    n = 5 + int.from_bytes(packed[1:5], "little")
    return np.frombuffer(expand(packed[5:n]), np.uint8 if packed[0] else np.uint32).astype(np.int64), expand(packed[n:])


def _pieces(lengths: np.ndarray, data):
    ends = np.cumsum(lengths).tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


class _Block:
    """Distinct pieces of a block's texts with their pre-tokens, and each text as numbers of pieces."""

    def __init__(self, texts: list[str], pattern: str):
        self.texts = [np.zeros(0, np.int32)] * len(texts)
        able = [plain(t) for t in texts]
        cuts: list[tuple[list[int], Pieces]] = []
        at = 0
        while at < len(texts):  # texts of about half a megabyte at a time: numpy holds 8 bytes for each of theirs
            some, size = [], 0
            while at < len(texts) and size < 1 << 19:
                if able[at]:
                    some.append(at)
                    size += len(texts[at])
                at += 1
            if some:
                cuts.append((some, Pieces([texts[k] for k in some])))
        example, number = distinct(np.concatenate([c.keys for _, c in cuts])) if cuts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        pieces: list[str] = [""] * len(example)
        first = 0
        for some, cut in cuts:
            last = first + len(cut.keys)
            own = np.flatnonzero((example >= first) & (example < last))
            for k, x in zip(own.tolist(), cut.texts(example[own] - first), strict=True):
                pieces[k] = x
            place = number[first:last].astype(np.int32)[cut.place]
            for k, a, b in zip(some, cut.bounds[:-1].tolist(), cut.bounds[1:].tolist(), strict=True):
                self.texts[k] = place[a:b]
            first = last
        for k, text in enumerate(texts):
            if text and not able[k]:
                self.texts[k] = np.array([len(pieces)], np.int32)
                pieces.append(text)
        self.parts = list(map(cutter(pattern), pieces))

    def words(self, buckets: int) -> list[list[bytes]]:
        """The distinct pre-tokens by bucket in sorted order."""
        by: list[list[bytes]] = [[] for _ in range(buckets)]
        for w in map(str.encode, set().union(*self.parts)):
            by[zlib.crc32(w) % buckets].append(w)
        for x in by:
            x.sort()
        return by


def _gathered(flat: np.ndarray, ends: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of ``flat`` (number k ends at ends[k]) laid end to end by their numbers, and where each then ends."""
    begins = np.append(0, ends[:-1])[: len(ends)]
    lengths = (ends - begins)[numbers]
    total = np.cumsum(lengths)
    places = np.repeat(begins[numbers] - (total - lengths), lengths)
    places += np.arange(len(places))
    return flat[places], total


def _runs(texts: list[np.ndarray], size: int) -> Iterator[list[np.ndarray]]:
    """Consecutive texts of about ``size`` pieces together."""
    some, held = [], 0
    for t in texts:
        some.append(t)
        held += len(t)
        if held >= size:
            yield some
            some, held = [], 0
    if some:
        yield some


def assembled(docs: DataFrame, form: Callable[[list[np.ndarray]], list[pa.Array]], schema: str, path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """``key`` and what ``form(ids of each text)`` makes of each block: arrays by the columns of ``schema``."""
    spark = prepare(docs.sparkSession)
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, buckets = spread(total, BLOCK_BYTES, parts), max(1, math.ceil(total / BUCKET_BYTES))
    kind = docs.schema[key].dataType.simpleString()
    dealt = docs.select(key, "text", F.pmod(F.xxhash64(key, "text"), F.lit(blocks)).cast("int").alias("block")).repartition(max(parts, blocks), "block")

    @calm
    def ask(group: pa.Table) -> pa.Table:
        by = _Block(texts_of(group.column("text")), pattern).words(buckets)
        asked = [(k, _packed([len(w) for w in x], b"".join(x))) for k, x in enumerate(by) if x]
        block = group.column("block")[0].as_py()
        return pa.table({"block": pa.array([block] * len(asked), pa.int32()), "bucket": pa.array([k for k, _ in asked], pa.int32()), "words": pa.array([x for _, x in asked], pa.binary())})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at = encoding_of(path, WHOLE).encode_ordinary, None
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            out = []
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("words"), strict=True):
                if bucket != at:  # the words of another bucket are others
                    at, known = bucket, {}
                ids = []
                for w in _pieces(*_unpacked(data.as_py())):
                    if (got := known.get(w)) is None:
                        got = known[w] = encode(w.decode())
                    ids.append(got)
                flat = np.array([x for got in ids for x in got], np.uint32)
                out.append(_packed([len(x) for x in ids], (flat.astype(np.uint16) if flat.max() < 1 << 16 else flat).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())], names=["block", "bucket", "ids"])

    @calm
    def put_together(group: pa.Table, answers: pa.Table) -> pa.Table:
        own, keys = _Block(texts_of(group.column("text")), pattern), group.column(key)
        by = own.words(buckets)
        counts, flat, number = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], {}
        for bucket, data in zip(answers.column("bucket").to_pylist(), answers.column("ids").to_pylist(), strict=True):
            n, ids = _unpacked(data)
            number.update(zip(map(bytes.decode, by[bucket]), range(len(number), len(number) + len(n)), strict=True))
            counts.append(n)
            flat.append(np.frombuffer(ids, np.uint16 if len(ids) == 2 * n.sum() else np.uint32).astype(np.uint32))
        # ids of words, then of pieces, then of texts
        words = np.array([number[w] for p in own.parts for w in p], np.int64)
        made, ends = _gathered(np.concatenate(flat), np.cumsum(np.concatenate(counts)), words)
        ends = np.append(0, ends)[np.cumsum([len(p) for p in own.parts], dtype=np.int64)] if own.parts else np.zeros(0, np.int64)
        del by, number, words
        own.parts.clear()
        ids: list[np.ndarray] = []
        for some in _runs(own.texts, TOGETHER):
            flat_, last = _gathered(made, ends, np.concatenate(some))
            cuts = np.append(0, last)[np.cumsum([len(t) for t in some])]
            ids += np.split(flat_, cuts[:-1])
        return pa.table([keys, *form(ids)], names=names)

    names = [key, *(x.split()[0] for x in schema.split(", "))]
    asked = dealt.groupBy("block").applyInArrow(ask, "block int, bucket int, words binary")
    answered = asked.repartition(max(parts, buckets), "bucket").sortWithinPartitions("bucket").mapInArrow(answer, "block int, bucket int, ids binary")
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(put_together, f"`{key}` {kind}, {schema}")


def _lists(ids: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)), pa.array(np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)))


def _decoder(path: str) -> Callable[[np.ndarray], bytes]:
    table_ = token_bytes(path)
    of = [table_.get(k, b"") for k in range(max(table_) + 1)].__getitem__
    return lambda ids: b"".join(map(of, ids.tolist()))


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, key: str = "doc_id") -> DataFrame:
    """(key, ids): the token ids of each whole text as array<int>."""
    return assembled(docs, lambda ids: [_lists(ids)], "ids array<int>", path or public_tokenizers.path(RANKS), pattern, key)


def encode_checked(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids, decoded_sha256): the ids of each whole text, and the digest of the bytes that they decode to."""
    path = path or public_tokenizers.path(RANKS)

    def form(ids: list[np.ndarray]) -> list[pa.Array]:
        back = _decoder(path)
        return [pa.array([len(x) for x in ids], pa.int64()), _lists(ids), pa.array([hashlib.sha256(back(x)).hexdigest() for x in ids], pa.string())]

    return assembled(docs, form, "n_tokens bigint, ids array<int>, decoded_sha256 string", path, pattern, key)


def decode(encoded: DataFrame, path: str | None = None, key: str = "doc_id") -> DataFrame:
    """(key, text_bytes): the bytes of each array of ids by the token-byte table."""
    path = path or public_tokenizers.path(RANKS)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = token_bytes(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([b"".join(map(table_.__getitem__, x or ())) for x in b.column(1).to_pylist()], pa.binary())], names=[key, "text_bytes"])

    return prepare(encoded.sparkSession) and encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text_bytes binary")


def digests(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256), without carrying ids between tasks."""
    path = path or public_tokenizers.path(RANKS)

    def form(ids: list[np.ndarray]) -> list[pa.Array]:
        back = _decoder(path)
        number = list(map(str, range(max(token_bytes(path)) + 1))).__getitem__
        told = [hashlib.sha256(" ".join(map(number, x.tolist())).encode()).hexdigest() for x in ids]
        return [pa.array([len(x) for x in ids], pa.int64()), pa.array(told, pa.string()), pa.array([hashlib.sha256(back(x)).hexdigest() for x in ids], pa.string())]

    return assembled(docs, form, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", path, pattern, key)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes that they decode to."""
    return digests(table(spark, sf_dir, "documents"))
