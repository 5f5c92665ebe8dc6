"""Suffix-array dedup: remove bytes that a long enough repeated byte string covers.

The repeats are found on a Burrows-Wheeler transform by threshold-bounded interval expansion: intervals of prefixes are
extended backward breadth first, so that common prefixes between neighbouring suffixes come out by increasing value,
and stop at ``LENGTH``. Neighbours that have none by then share at least that many bytes (``repeated``).

One transform over a whole corpus would be one task, so windows of ``LENGTH`` bytes are dealt first. Each window takes
the least hash of the ``SEED``-byte strings in it as its key: equal windows have equal keys, and consecutive windows
of one key form a segment (of at most ``longest`` windows). Every text is cut into segments once, by its block:

1. A block sends each key's distinct segments as hashes to the key's bucket. A segment that stands there twice repeats
   as a whole. One that is alone but shares its key with unlike segments has to be compared; of copies of such a segment
   one block sends the bytes.
2. A bucket transforms the segments of batches of whole keys and tells each window's block whether it repeats.

A key with more than ``hot`` unlike segments (``hot_here`` in one block), such as that of a line which stands in a third
of all documents, is not gathered anywhere: its windows are dealt by a hash of their own, in which only copies of one
window meet, and a block sends each of them once. So no key makes a task large: a key has at most ``hot_here`` entries
from a block, and a transform at most ``hot`` segments of a key.

Segments of one key are told apart by 64 bits of another hash than the key's, windows of hot keys by 128; all other
windows are compared as bytes.

Repeats shorter than ``LENGTH`` stay, but are told besides: of the ``SEED``-byte strings in a text, those whose hash is
divisible by ``each`` are its anchors, and ``n_shared`` counts the bytes that anchors cover which start anywhere else too.
A passage of 300 bytes has an anchor with a chance of 97 %.

Places in a block are those of its texts in one order (``in_order``): a shuffle brings rows in another one each time.

Cases: null or empty text has no bytes; rows are documents of their own, so repeated rows cover each other; texts
shorter than ``LENGTH`` stay; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import arrow, bits, cut, deal, flags_of, in_order, seen_twice
from .common import bytes_of, calm, table
from .hashing import BYTE, P, U, inside_runs, mix, powers, sliding_min, stretches, sums

LENGTH, SEED, PLACE = 400, 128, 24


@dataclass(frozen=True)
class Limits:
    """Sizes that change no result (but ``each`` what is an anchor); small ones are for tests."""

    slice: int = 1 << 16  # places that are hashed at once: a core's cache holds them
    longest: int = 1024  # windows of a segment
    hot: int = 2048  # unlike segments of a key that meet
    hot_here: int = 32  # those of one block
    each: int = 48  # strings of which one is an anchor
    batch: int = 1 << 17  # bytes of a transform, which has whole keys


#: What a bucket says about an entry: nothing repeats, all of it does, its bytes are needed, or its key is hot.
ALONE, WHOLE, SEND, SEND_WHOLE, SPLIT = range(5)
#: One row for each block and bucket; ``kept`` has the block's own segments, which come back to it.
ROWS = "block int, bucket int, entries binary, keys binary, contents binary, flags binary, kept binary"


def suffix_order(s: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotations of ``s`` (symbols of 9 bits) in the order of at least their first ``depth`` symbols, and the keys of 7
    symbols from each place. Ties beyond the depth are in any order, which intervals of shorter strings don't notice."""
    n = len(s)
    wide = np.concatenate([s, np.resize(s, 6)]).astype(U)
    key = np.zeros(n, U)
    for j in range(7):
        key = (key << U(9)) | wide[j : j + n]
    order = np.argsort(key)
    new = np.append(True, key[order][1:] != key[order][:-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    width = max(1, int(n - 1).bit_length())
    times = 63 // width
    h = 7
    while h < depth:
        # only rows whose group has more than one member
        alone = new & np.append(new[1:], True)
        rows = np.flatnonzero(~alone)
        if not len(rows):
            break
        at = order[rows]
        pack = rank[at].astype(U)
        for t in range(1, times):
            pack = (pack << U(width)) | rank[(at + t * h) % n].astype(U)
        by = np.argsort(pack)
        at, pack = at[by], pack[by]
        order[rows] = at
        fresh = np.append(True, pack[1:] != pack[:-1])
        new[rows] = fresh
        rank[at] = rows[np.maximum.accumulate(np.where(fresh, np.arange(len(rows)), 0))]
        h *= times
    return order, key


def _common(key: np.ndarray, order: np.ndarray, parts: int) -> np.ndarray:
    """Common prefix of each row with the one before it, counted up to 7 * parts symbols."""
    n, out = len(order), np.zeros(len(order), np.int64)
    open_ = np.arange(1, n)
    for p in range(parts):
        a, b = key[(order[open_] + 7 * p) % n], key[(order[open_ - 1] + 7 * p) % n]
        x = a ^ b
        same = x == 0
        high = np.floor(np.log2(np.maximum((x[~same] >> U(9)).astype(np.float64), 0.5))).astype(np.int64) + 9
        low = x[~same] < U(512)
        symbol = np.where(low, 6, 6 - high // 9)
        # the float logarithm may round up at a symbol's border: look at the symbol itself
        off = (symbol < 6) & ((x[~same] >> (U(9) * (6 - symbol).astype(U))) == 0)
        out[open_[~same]] += symbol + off
        out[open_[same]] += 7
        open_ = open_[same]
    return out


def repeated(s: np.ndarray, length: int) -> np.ndarray:
    """For each place of ``s``: whether the ``length`` symbols (7 or more) from there start anywhere else too."""
    if length < 7:
        raise ValueError("the sorted keys tell the first 7 symbols apart; length must be 7 or more")
    n = len(s)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    order, key = suffix_order(s, length)
    before = s[order - 1]
    # LF mapping, and the rows before and after each one with the same symbol
    by = np.argsort(before, kind="stable")
    lf = np.empty(n, np.int64)
    lf[by] = np.arange(n)
    change = before[by][1:] != before[by][:-1]
    nxt, prv = np.full(n, n), np.full(n, -1)
    nxt[by[:-1]] = np.where(change, n, by[1:])
    prv[by[1:]] = np.where(change, -1, by[:-1])
    # common prefixes below ``level`` are read off the sorted keys; expansion derives the rest
    parts = max(1, min(3, length // 7))
    level = 7 * parts
    common = _common(key, order, parts)
    known = np.ones(n + 1, bool)
    known[:n] = common < level
    group = np.maximum.accumulate(np.where(known[:n], np.arange(n), 0))
    right = np.flatnonzero(common[1:] == level - 1)
    left = group[right]
    while level < length and len(left):
        run, offset = inside_runs(right - left + 1)
        rows = left[run] + offset
        j = np.sort(lf[rows[nxt[rows] > right[run]]])
        i = np.sort(lf[rows[prv[rows] < left[run]]])
        open_ = ~known[j + 1]
        left, right = i[open_], j[open_]
        known[right + 1] = True
        level += 1
    twice = ~known[:n]
    twice[:-1] |= ~known[1:n]
    out[order] = twice
    return out


def repeated_windows(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment and each of its windows: whether that byte string starts anywhere else in the segments."""
    sizes = np.array([len(x) for x in segments])
    s = np.frombuffer(b"\0".join([*segments, b""]), np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(sizes + 1)
    s[ends - 1] = 0
    flags = repeated(s, length)
    return [flags[e - 1 - n : e - length] for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def hashed(data: np.ndarray, length: int, seed: int, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(a, b, hashes): the hashes of the ``seed``-byte strings from a on, as many as windows from a to b need."""
    n = max(len(data) - length + 1, min(1, len(data)))
    for a in range(0, n, size):
        b = min(a + size, n)
        part = data[a : b + length - 1]
        if len(part) >= seed:
            prefix, down = sums(BYTE[part]), powers(len(part) + 1)[1]
            yield a, b, (prefix[seed:] - prefix[:-seed]) * down[: len(part) - seed + 1]


class Anchors:
    """The anchors of texts laid end to end: places, distinct keys in order, each place's number among those, and whether
    a key has several places."""

    def __init__(self, offsets: np.ndarray, seed: int, found: list[tuple[int, np.ndarray]]):
        self.place = np.concatenate([np.zeros(0, np.int64), *(a for a, _ in found)])
        hashes = np.concatenate([np.zeros(0, U), *(h for _, h in found)])
        doc = np.searchsorted(offsets, self.place, side="right") - 1
        ok = self.place + seed <= offsets[1:][doc] if len(self.place) else np.zeros(0, bool)
        self.place = self.place[ok]
        self.keys, self.number, times = np.unique(hashes[ok], return_inverse=True, return_counts=True)
        self.many = times > 1

    @staticmethod
    def of(a: int, b: int, hashes: np.ndarray, last: bool, each: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of a slice, and of what is behind its windows if it is the last."""
        own = hashes if last else hashes[: b - a]
        at = np.flatnonzero((own >> U(33)) % U(each) == 0)
        return at + a, own[at]


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, seed: int, limits: Limits) -> Anchors:
    n = len(data) - length + 1
    return Anchors(offsets, seed, [Anchors.of(a, b, h, b >= n, limits.each) for a, b, h in hashed(data, length, seed, limits.slice)])


def segments_of(data: np.ndarray, offsets: np.ndarray, length: int, seed: int, limits: Limits) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Anchors]:
    """The segments of texts laid end to end: key, first window, number of windows, and whether windows of it may be equal;
    and the anchors."""
    width, mask = length - seed + 1, (1 << PLACE) - 1
    n = len(data) - length + 1
    starts, keys, again = [np.zeros(0, np.int64)], [np.zeros(0, U)], [np.zeros(0, bool)]
    found = []
    held = None
    for a, b, hashes in hashed(data, length, seed, limits.slice):
        found.append(Anchors.of(a, b, hashes, b >= n, limits.each))
        if n <= 0:
            break
        # the upper bits order the strings, the lower ones have the first place of the least in each window
        least = sliding_min((hashes & ~U(mask)) | np.arange(len(hashes), dtype=U), width)
        at = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
        own = hashes[(least[at] & U(mask)).astype(np.int64)]
        first = np.append(held is None or own[0] != held, own[1:] != own[:-1])
        starts.append(at + a)
        keys.append(own)
        again.append(~first)
        held = own[-1]
    at, key, again_ = np.concatenate(starts), np.concatenate(keys), np.concatenate(again)
    # cut at the ends of texts, where windows of one text end, and after every so many windows
    whole = np.maximum(offsets[:-1], offsets[1:] - length + 1)
    edge = np.unique(np.concatenate([at[~again_], offsets[:-1], whole]))
    edge = edge[edge < max(n, 0)]
    count = np.diff(np.append(edge, max(n, 0)))
    pieces = -(-count // limits.longest)
    run, k = inside_runs(pieces)
    start = edge[run] + k * limits.longest
    count = np.minimum(limits.longest, count[run] - k * limits.longest)
    doc = np.searchsorted(offsets, start, side="right") - 1
    ok = start < whole[doc] if len(start) else np.zeros(0, bool)
    start, count = start[ok], count[ok]
    # the least string's first place moves within a segment only if it stands in it twice
    moved = np.cumsum(np.append(0, again_))
    twice = moved[np.searchsorted(at, start + count, side="left")] > moved[np.searchsorted(at, start, side="right")]
    own = key[np.searchsorted(at, start, side="right") - 1] if len(start) else np.zeros(0, U)
    return own, start, count, twice, Anchors(offsets, seed, found)


class Entries:
    """What a block asks about: its distinct segments by (key, content), or one entry for a key with many."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, seed: int, limits: Limits):
        import xxhash

        key, self.start, self.count, twice, self.anchors = segments_of(data, offsets, length, seed, limits)
        raw, digest = data.tobytes(), xxhash.xxh3_64_intdigest
        content = np.array([digest(raw[s:e]) for s, e in zip(self.start.tolist(), (self.start + self.count + length - 1).tolist(), strict=True)], U)
        order = np.lexsort((content, key))
        k, c = key[order], content[order]
        new_key = np.append(True, k[1:] != k[:-1])[: len(k)]
        new = new_key | np.append(True, c[1:] != c[:-1])[: len(k)]
        of_key = np.cumsum(new_key) - 1
        hot = (np.bincount(of_key[new]) > limits.hot_here)[of_key] if len(k) else new
        lead = np.where(hot, new_key, new)
        number = np.cumsum(lead) - 1
        self.entry = np.empty(len(k), np.int64)
        self.entry[order] = number
        self.keys, self.contents, hot = k[lead], c[lead], hot[lead]
        many = np.bincount(number) > 1 if len(k) else hot
        self_like = np.zeros(len(self.keys), bool)
        np.logical_or.at(self_like, number, twice[order])
        self.flags = (hot * 4 + self_like * 2 + (many & ~hot)).astype(np.uint8)

    def kept(self) -> bytes:
        """Segments in the order of the text: first window, number of windows and entry."""
        import zstandard

        parts = [np.diff(self.start, prepend=0).astype(np.int32), self.count.astype(np.uint16), self.entry.astype(np.int32)]
        return len(self.start).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in parts))


def _unpacked(kept: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = int.from_bytes(kept[:4], "little")
    data = _expanded(kept[4:])
    return np.cumsum(np.frombuffer(data, np.int32, n), dtype=np.int64), np.frombuffer(data, np.uint16, n, 4 * n).astype(np.int64), np.frombuffer(data, np.int32, n, 6 * n).astype(np.int64)


def _expanded(packed: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(packed)


def judged(rows: list[dict], hot: int) -> list[tuple]:
    """A bucket's first answer: for each block the entries that something is to be done about, what, and their keys."""
    sizes = [len(r["flags"]) for r in rows]
    keys, contents = (np.frombuffer(b"".join(r[c] for r in rows), U) for c in ("keys", "contents"))
    flags = np.frombuffer(b"".join(r["flags"] for r in rows), np.uint8)
    order = np.lexsort((contents, keys))
    k, c, f = keys[order], contents[order], flags[order]
    new_key = np.append(True, k[1:] != k[:-1])[: len(k)]
    new = new_key | np.append(True, c[1:] != c[:-1])[: len(k)]
    of_key, of = np.cumsum(new_key) - 1, np.cumsum(new) - 1
    kinds = np.bincount(of_key[new]) if len(k) else np.zeros(0, np.int64)  # unlike contents of a key
    split = np.zeros(len(kinds), bool)
    np.logical_or.at(split, of_key, f >= 4)
    split |= kinds > hot
    copies = np.zeros(int(of[-1]) + 1 if len(of) else 0, np.int64)
    np.add.at(copies, of, 1 + (f & 1))
    like_self = (f & 2) > 0
    compare = new & ((kinds[of_key] > 1) | (like_self & (copies[of] == 1)))  # the first that has a content sends it
    got = np.where(split[of_key], SPLIT, np.where(copies[of] > 1, WHOLE, ALONE) + np.where(compare, SEND, ALONE)).astype(np.uint8)
    said = np.empty(len(got), np.uint8)
    said[order] = got
    out, at = [], 0
    for r, n in zip(rows, sizes, strict=True):
        own = np.flatnonzero(said[at : at + n])
        out.append((r["block"], r["bucket"], np.frombuffer(r["entries"], np.int32)[own].tobytes(), keys[at + own].tobytes(), None, said[at + own].tobytes(), None))
        at += n
    return out


def compared(keys: list[np.ndarray], texts: list[list[bytes]], length: int, most: int) -> list[bytes]:
    """A bucket's second answer about segments: a bit for each window of each block's segments."""
    places = sorted((k, b, i) for b, own in enumerate(keys) for i, k in enumerate(own.tolist()))
    found: list[list] = [[None] * len(x) for x in texts]
    batch: list[tuple[int, int, int]] = []
    held = 0

    def done() -> None:
        for (_, b, i), flags in zip(batch, repeated_windows([texts[b][i] for _, b, i in batch], length), strict=True):
            found[b][i] = flags
        batch.clear()

    for x in places:
        if held > most and batch[-1][0] != x[0]:
            done()
            held = 0
        batch.append(x)
        held += len(texts[x[1]][x[2]])
    if batch:
        done()
    return [bits(np.concatenate([*x, np.zeros(0, bool)])) for x in found]


def _window_hashes(data: np.ndarray, start: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every window of these segments."""
    first, second = [np.zeros(0, U)], [np.zeros(0, U)]
    for s, n in zip(start.tolist(), count.tolist(), strict=True):
        part = BYTE[data[s : s + n + length - 1]]
        at = np.arange(n)
        first.append(stretches(sums(part), at, at + length))
        second.append(stretches(sums(mix(part ^ U(P))), at, at + length))
    return np.concatenate(first), np.concatenate(second)


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorting by (a, b): the order, and where something new begins in it."""
    order = np.lexsort((b, a))
    return order, np.append(True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]))[: len(a)]


def met(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[bytes]:
    """A bucket's second answer about windows of hot keys: for each block's (hash, hash, many), whether there are others."""
    a, b, many = map(np.concatenate, zip(*rows, strict=True))
    order, new = _distinct(a, b)
    of = np.cumsum(new) - 1
    times = np.zeros(int(of[-1]) + 1 if len(of) else 0, np.int64)
    np.add.at(times, of, 1 + many[order])
    out = np.empty(len(a), bool)
    out[order] = times[of] > 1
    return [bits(x) for x in np.split(out, np.cumsum([len(x) for x, _, _ in rows])[:-1])]


def remove_repeats(df: DataFrame, length: int = LENGTH, seed: int = SEED, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, n_shared, kept): kept has the remaining bytes of each text."""
    kind = df.schema["doc_id"].dataType.simpleString()
    dealt, buckets = deal(df)

    def own_bucket(block: int) -> int:
        """Rows that only come back to their block, in a group of their own."""
        return -1 - block

    @calm
    def first(group: pa.Table) -> pa.Table:
        group = in_order(group)
        own = Entries(*bytes_of(group.column("text").combine_chunks()), length, seed, limits)
        block = group.column("block")[0].as_py()
        rows = [(block, k, p.astype(np.int32).tobytes(), own.keys[p].tobytes(), own.contents[p].tobytes(), own.flags[p].tobytes(), None) for k, p in enumerate(cut(own.keys, buckets)) if len(p)]
        near = own.anchors
        rows += [(block, k, None, near.keys[p].tobytes(), None, bits(near.many[p]), None) for k, p in enumerate(cut(near.keys, buckets)) if len(p)]
        return arrow([*rows, (block, own_bucket(block), None, None, None, None, own.kept())], ROWS)

    @calm
    def first_answer(rows: pa.Table) -> pa.Table:
        if rows.column("bucket")[0].as_py() < 0:
            return rows
        x = rows.to_pylist()
        near = [r for r in x if r["entries"] is None]
        keys = [np.frombuffer(r["keys"], U) for r in near]
        shared = seen_twice(keys, [flags_of(r["flags"], len(k)) for r, k in zip(near, keys, strict=True)]) if near else []
        told = [(r["block"], r["bucket"], None, None, None, f, None) for r, f in zip(near, shared, strict=True)]
        return arrow(judged([r for r in x if r["entries"] is not None], limits.hot) + told, ROWS)

    def known(answers: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A block's segments, and what is said about each entry."""
        start, count, entry = _unpacked(next(r["kept"] for r in answers if r["kept"] is not None))
        said = np.zeros(int(entry.max(initial=-1)) + 1, np.uint8)
        for r in answers:
            if r["bucket"] >= 0 and r["entries"] is not None:
                said[np.frombuffer(r["entries"], np.int32)] = np.frombuffer(r["flags"], np.uint8)
        return start, count, entry, said

    def hot_windows(data: np.ndarray, start: np.ndarray, count: np.ndarray, hot: np.ndarray):
        """The windows of the segments ``hot``: their distinct hashes, each window's number among those, and those numbers by bucket."""
        a, b = _window_hashes(data, start[hot], count[hot], length)
        order, new = _distinct(a, b)
        number = np.empty(len(a), np.int64)
        number[order] = np.cumsum(new) - 1
        a, b = a[order][new], b[order][new]
        return a, b, number, cut(a, buckets)

    @calm
    def second(group: pa.Table, answers: pa.Table) -> pa.Table:
        import zstandard

        if not group.num_rows:
            return arrow([], ROWS)
        group, answers = in_order(group), answers.to_pylist()
        start, count, entry, said = known(answers)
        data, _ = bytes_of(group.column("text").combine_chunks())
        block, compress = group.column("block")[0].as_py(), zstandard.ZstdCompressor(level=3).compress
        example = np.zeros(len(said), np.int64)
        example[entry[::-1]] = np.arange(len(entry))[::-1]
        rows = []
        for r in answers:
            if r["bucket"] < 0:
                rows.append((block, r["bucket"], None, None, None, None, r["kept"]))
                continue
            if r["entries"] is None:  # shared anchors, with their bucket
                rows.append((block, own_bucket(block), None, r["bucket"].to_bytes(4, "little"), None, r["flags"], None))
                continue
            own, flags, keys = np.frombuffer(r["entries"], np.int32), np.frombuffer(r["flags"], np.uint8), np.frombuffer(r["keys"], U)
            rows.append((block, own_bucket(block), r["entries"], None, None, r["flags"], None))
            sent = (flags == SEND) | (flags == SEND_WHOLE)
            if sent.any():
                at = example[own[sent]]
                texts = [data[s : s + c + length - 1].tobytes() for s, c in zip(start[at].tolist(), count[at].tolist(), strict=True)]
                rows.append((block, r["bucket"], own[sent].tobytes(), keys[sent].tobytes(), compress(b"".join(texts)), count[at].astype(np.uint16).tobytes(), None))
        hot = np.flatnonzero(said[entry] == SPLIT)
        if len(hot):
            a, b, number, by = hot_windows(data, start, count, hot)
            many = np.bincount(number) > 1
            for k, p in enumerate(by):
                if len(p):
                    rows.append((block, k, None, a[p].tobytes(), b[p].tobytes(), bits(many[p]), None))
        return arrow(rows, ROWS)

    @calm
    def second_answer(rows: pa.Table) -> pa.Table:
        if rows.column("bucket")[0].as_py() < 0:
            return rows
        x = rows.to_pylist()
        asked, hot = [r for r in x if r["entries"] is not None], [r for r in x if r["entries"] is None]
        out = []
        if asked:
            texts = []
            for r in asked:
                data, ends = _expanded(r["contents"]), np.cumsum(np.frombuffer(r["flags"], np.uint16).astype(np.int64) + length - 1).tolist()
                texts.append([data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)])
            answered = compared([np.frombuffer(r["keys"], U) for r in asked], texts, length, limits.batch)
            out += [(r["block"], r["bucket"], r["entries"], None, f, r["flags"], None) for r, f in zip(asked, answered, strict=True)]
        if hot:
            keys = [np.frombuffer(r["keys"], U) for r in hot]
            answered = met([(k, np.frombuffer(r["contents"], U), flags_of(r["flags"], len(k))) for r, k in zip(hot, keys, strict=True)])
            out += [(r["block"], r["bucket"], None, None, f, None, None) for r, f in zip(hot, answered, strict=True)]
        return arrow(out, ROWS)

    @calm
    def last(group: pa.Table, answers: pa.Table) -> pa.Table:
        group = in_order(group)
        data, offsets = bytes_of(group.column("text").combine_chunks())
        answers = answers.to_pylist()
        start, count, entry = _unpacked(next(r["kept"] for r in answers if r["kept"] is not None))
        said = np.zeros(int(entry.max(initial=-1)) + 1, np.uint8)
        flags: dict[int, np.ndarray] = {}
        for r in answers:
            if r["bucket"] < 0 and r["entries"] is not None:
                said[np.frombuffer(r["entries"], np.int32)] = np.frombuffer(r["flags"], np.uint8)
            elif r["bucket"] >= 0 and r["entries"] is not None:
                counts = np.frombuffer(r["flags"], np.uint16).astype(np.int64)
                own = flags_of(r["contents"], int(counts.sum()))
                flags.update(zip(np.frombuffer(r["entries"], np.int32).tolist(), np.split(own, np.cumsum(counts)[:-1]), strict=True))
        step = np.zeros(len(data) + 1, np.int32)

        def cover(s: np.ndarray, e: np.ndarray) -> None:
            np.add.at(step, s, 1)
            np.add.at(step, e, -1)

        status = said[entry]
        whole = np.flatnonzero((status == WHOLE) | (status == SEND_WHOLE))
        cover(start[whole], start[whole] + count[whole] + length - 1)
        for k in np.flatnonzero(status == SEND).tolist():
            at = start[k] + np.flatnonzero(flags[int(entry[k])])
            cover(at, at + length)
        hot = np.flatnonzero(status == SPLIT)
        if len(hot):
            a, _, number, by = hot_windows(data, start, count, hot)
            found = np.zeros(len(a), bool)
            for r in answers:
                if r["bucket"] >= 0 and r["entries"] is None:
                    found[by[r["bucket"]]] = flags_of(r["contents"], len(by[r["bucket"]]))
            run, k = inside_runs(count[hot])
            at = (start[hot][run] + k)[found[number]]
            cover(at, at + length)
        gone = np.cumsum(step[:-1], dtype=np.int32) > 0
        near = anchors_of(data, offsets, length, seed, limits)
        by, shared = cut(near.keys, buckets), np.zeros(len(near.keys), bool)
        for r in answers:
            if r["bucket"] < 0 and r["entries"] is None and r["kept"] is None:
                own = by[int.from_bytes(r["keys"], "little")]
                shared[own] = flags_of(r["flags"], len(own))
        at = near.place[shared[near.number]]
        step[:] = 0
        cover(at, at + seed)
        covered = np.append(0, np.cumsum(np.cumsum(step[:-1], dtype=np.int32) > 0))
        edge = np.append(False, gone)
        edge[offsets] = False
        spans = np.append(0, np.cumsum(gone & ~edge[:-1]))
        removed = np.append(0, np.cumsum(gone))
        a, b = offsets[:-1], offsets[1:]
        kept = [data[x:y].tobytes() if n == 0 else data[x:y][~gone[x:y]].tobytes() for x, y, n in zip(a.tolist(), b.tolist(), (removed[b] - removed[a]).tolist(), strict=True)]
        return pa.table({"doc_id": group.column("doc_id"), "n_bytes": pa.array(b - a), "n_removed": pa.array(removed[b] - removed[a]), "n_spans": pa.array(spans[b] - spans[a]), "n_shared": pa.array(covered[b] - covered[a]), "kept": pa.array(kept, pa.binary())})

    asked = dealt.groupBy("block").applyInArrow(first, ROWS).groupBy("bucket").applyInArrow(first_answer, ROWS)
    again = dealt.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(second, ROWS).groupBy("bucket").applyInArrow(second_answer, ROWS)
    return dealt.groupBy("block").cogroup(again.groupBy("block")).applyInArrow(last, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, n_shared bigint, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its bytes, those removed, in how many runs, the digest of the kept ones, and the bytes of shared anchors."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared")


def brute_force(rows: list[tuple[int, str]], length: int = LENGTH) -> list[tuple[int, int, int, int, str]]:
    """The same result by its definition, for tests."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    times = Counter(t[k : k + length] for _, t in texts for k in range(len(t) - length + 1))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - length + 1):
            if times[t[k : k + length]] > 1:
                gone[k : k + length] = True
        spans = int((gone[:-1] & ~np.append(False, gone[:-2] if len(t) > 1 else gone[:0])[: len(t)]).sum()) if len(t) else 0
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=False) if not g)).hexdigest()))
    return out
