"""Cutting texts for byte-level BPE: by numpy at white space and marks, then by the pattern.

In a text without runs of white space, a blank starts a pre-token, any other white space is one by itself, and a mark
at a word's end parts from a letter or digit before it. So such a text falls apart there into pieces whose pre-tokens
do not depend on their neighbours. Pieces are told apart by hash with what stands before them; they repeat, and each
distinct one becomes a Python string, and is cut by the (slow) pattern, once. Other texts stay whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .common import bytes_of
from .hashing import APART, P, U, mix, slices, word_hashes, words_of

RUN = re.compile(r"\s\s")
#: White space besides blanks and line feeds.
CONTROLS = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
RARE = re.compile(f"[{CONTROLS}\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def plain(text: str) -> bool:
    """Whether a text may be cut: no white space at its ends, no runs of it."""
    if not text or text[0].isspace() or text[-1].isspace() or "  " in text or "\n\n" in text or "\n " in text or " \n" in text:
        return False
    rare = any(c in text for c in CONTROLS) if text.isascii() else RARE.search(text)
    return not rare or not RUN.search(text)


#: Bytes of letters in ASCII and of the two Latin blocks after it (U+00C0 to U+017F); of these, two characters are signs.
LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = True
SIGNS = (0x97, 0xB7)
MARKS = frozenset(".,;:!?)")
MARK = np.isin(np.arange(256), [ord(c) for c in MARKS])
LEAD = {0: "", 255: "", **{x: chr(x) for x in (*range(9, 14), 32)}}


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one example of each distinct key, and for each key its number among those. Unlike numpy's unique,
    the sort need not be stable."""
    order = np.argsort(keys)
    edge = np.append(True, keys[order][1:] != keys[order][:-1])[: len(keys)]
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(edge) - 1
    return order[edge], number


class Pieces:
    """The distinct pieces of plain texts as ``keys``; ``place`` has each piece's number in texts laid end to end, of
    which text k has [bounds[k], bounds[k + 1])."""

    def __init__(self, texts: list[str]):
        self.data, offsets = bytes_of(pa.array(texts, pa.string()))
        found, bounds, n = [], [np.zeros(1, np.int64)], 0
        for a, b in slices(offsets):
            *own, ends = self._cut(self.data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            own[1], own[2] = own[1] + offsets[a], own[2] + offsets[a]
            found.append(own)
            bounds.append(ends[1:] + n)
            n += ends[-1]
        keys, start, end, apart = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(3)))
        sample, self.place = distinct(keys)
        self.keys, self.start, self.end, self.apart = keys[sample], start[sample], end[sample], apart[sample]
        self.bounds, self.raw = np.concatenate(bounds), self.data.tobytes()

    @staticmethod
    def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Keys, starts, ends and what stands before of all pieces, and for each text the number of pieces before it."""
        start, end, before = words_of(data, offsets)
        first = np.zeros(len(start) + 1, bool)
        first[before[:-1]] = True
        apart = np.where(first[:-1], 0, data[start - 1]).astype(np.int64)
        marked = MARK[data[end - 1]] & (end - start > 1) & ~APART[data[end - 2]] & (data[end - 2] < 128)
        at = np.flatnonzero(marked) + 1
        start, end = np.insert(start, at, end[marked] - 1), np.insert(end - marked, at, end[marked])
        apart = np.insert(apart, at, 255)
        keys = mix(word_hashes(data, start, end) ^ ((apart + 1).astype(U) * U(P)))
        return keys, start, end, apart, before + np.append(0, np.cumsum(marked))[before]

    def letters(self, numbers: np.ndarray) -> np.ndarray:
        """Which of these pieces are Latin letters throughout."""
        data = self.data
        other = np.zeros(len(data) + 1, np.int32)
        odd = ~LETTER[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        odd[lead[np.isin(data[lead + 1], SIGNS)]] = True
        np.cumsum(odd, out=other[1:])
        return other[self.end[numbers]] == other[self.start[numbers]]

    def texts(self, numbers: np.ndarray | list[int]) -> list[str]:
        raw = self.raw
        return [LEAD[p] + raw[s:e].decode() for p, s, e in zip(self.apart[numbers].tolist(), self.start[numbers].tolist(), self.end[numbers].tolist(), strict=True)]


def cutter(pattern: str) -> Callable[[str], list[str]]:
    """The pattern's matches in a chunk. With the public pattern, letters are one match, with a blank before them if
    there is one, and so is a mark that ends the chunk: most chunks need no regular expression."""
    import public_tokenizers
    import regex

    find = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return find

    def cut(chunk: str) -> list[str]:
        word = chunk[1:] if chunk[0] == " " else chunk
        if word.isalpha():
            return [chunk]
        if word[-1:] in MARKS and word[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return find(chunk)

    return cut
