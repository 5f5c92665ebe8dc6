"""Words and hashes over Arrow batches with numpy: no Python object for each word.

A hash of a stretch of bytes or words is a difference of prefix sums of ``T[x] * P**i`` modulo 2**64, brought to the
stretch's start by a power of P's inverse, then mixed. Values depend only on the content, so they agree between tasks.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
P = 0x9E3779B97F4A7C13
P_INVERSE = pow(P, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that part terms: ASCII that is neither letter nor digit.
APART = np.ones(256, bool)
APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


BYTE = mix(np.arange(1, 257, dtype=U) * U(P))
_powers = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i below n, kept between batches."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, p in enumerate((P, P_INVERSE)):
            row = np.full(size, p, U)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=U)
    return _powers[0][:n], _powers[1][:n]


def sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * P**i, with a leading 0."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values))[0], dtype=U, out=out[1:])
    return out


def stretches(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The mixed hash of each stretch [start, end) of what ``prefix`` sums."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(U))


def words_of(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the longest runs without ASCII white space (or without the bytes ``apart``), of texts laid end to end: start and end of each in ``data``,
    and for each text the number of words before it (one entry more than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~apart[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    start = np.flatnonzero(starts)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    return stretches(sums(BYTE[LOWER[data] if lower else data]), start, end)


def slices(offsets: np.ndarray, size: int = 1 << 17):
    """Consecutive texts of about ``size`` bytes together: what has 8 bytes for each of theirs stays in a core's cache. (first, last + 1)."""
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        yield first, last
        first = last


def hashed_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and for each text the number of words before it (one entry more than texts)."""
    hashes, before, n = [np.zeros(0, U)], [np.zeros(1, np.int64)], 0
    for a, b in slices(offsets):
        part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        start, end, count = words_of(part, own, apart)
        hashes.append(word_hashes(part, start, end, lower))
        before.append(count[1:] + n)
        n += len(start)
    return np.concatenate(hashes), np.concatenate(before)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive values; as many as there are places to start, regardless of text bounds."""
    at = np.arange(max(0, len(hashes) - k + 1))
    return stretches(sums(hashes), at, at + k)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    out, span = values, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (width - span)], out[width - span :]) if width > span else out


def inside_runs(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of these lengths laid end to end: the run and the place in it of each element."""
    run = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return run, np.arange(len(run)) - first[run]
