"""Vectorised byte-level text features shared by the two trained scorers.

Texts are joined by line feeds into one byte array; words and character n-grams
are found and hashed for all of it at once. A long text is read in pieces that end before the first white space
after PIECE bytes, so no word and no n-gram is split: an n-gram has white space at its ends only, and a piece's
edges stand for white space. Where a piece ends depends on its text alone, so equal texts give equal
features. Temporary arrays cover SLICE bytes at most, whatever a word's length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

PIECE = 1 << 18
BATCH = 1 << 19
#: More than a batch of ordinary pieces takes, so only a piece that is alone in its batch is read in slices.
SLICE = 1 << 21
_GAP = re.compile(rb"[\x09-\x0d\x20]")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Random values by byte and place (tabulation hashing), from a fixed seed.
_TABLE = np.random.Generator(np.random.PCG64(20240917)).integers(0, 1 << 63, (8, 256), np.uint64)
_POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def pieces(text: str | None) -> Iterator[bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    at = 0
    while len(raw) - at > PIECE and (gap := _GAP.search(raw, at + PIECE)):
        yield raw[at : gap.start()]
        at = gap.start()
    yield raw[at:] if at else raw


def batched(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(number of the text, piece) lists of about BATCH bytes in all; a piece of more than BATCH bytes (one word nearly) is alone."""
    owners, parts, size = [], [], 0
    for i, text in enumerate(texts):
        for part in pieces(text):
            if parts and (len(part) > BATCH or size >= BATCH):
                yield owners, parts
                owners, parts, size = [], [], 0
            owners.append(i)
            parts.append(part)
            size += len(part) + 1
    if parts:
        yield owners, parts


class Words:
    """The words of a list of byte strings: ``start``, ``end``, ``doc`` for each, over ``data``."""

    def __init__(self, parts: list[bytes], lower: bool = False):
        joined = b"\n".join([b"", *parts, b""])
        data = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.data, self.n_docs = data, len(parts)
        self.first = np.concatenate(([1], 1 + np.cumsum(sizes + 1)[:-1])) if len(parts) else np.zeros(0, np.int64)
        self.space = _SPACE[data]
        turns = np.nonzero(self.space[1:] != self.space[:-1])[0] + 1
        self.start, self.end = turns[0::2], turns[1::2]
        self.doc = np.searchsorted(self.first, self.start, side="right") - 1

    def counts(self) -> np.ndarray:
        return np.bincount(self.doc, minlength=self.n_docs)

    def hashes(self) -> np.ndarray:
        """One hash for each word, of its bytes and their places."""
        out = np.zeros(len(self.start), np.uint64)
        for at in range(0, len(self.data) if len(self.start) else 0, SLICE):
            end = min(at + SLICE, len(self.data))
            first, last = np.searchsorted(self.end, at, side="right"), np.searchsorted(self.start, end)
            if first == last:  # white space only
                continue
            start = np.maximum(self.start[first:last], at)
            place = np.arange(at, end) - np.repeat(np.concatenate(([0], self.start[first:last])), np.diff(np.concatenate(([at], start, [end]))))
            value = _TABLE[0][self.data[at:end]] * _POWERS[place & 4095]
            value[self.space[at:end]] = 0
            out[first:last] += np.add.reduceat(value, start - at)
        return mixed(out + (self.end - self.start).astype(np.uint64))

    def prefixes(self, n: int) -> np.ndarray:
        """A hash of each word's first n bytes; 0 for shorter words."""
        h = np.full(len(self.start), n, np.uint64)
        for k in range(n):
            h ^= _TABLE[k][self.data[np.minimum(self.start + k, len(self.data) - 1)]]
        return np.where(self.end - self.start >= n, mixed(h), np.uint64(0))

    def grams(self, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(position, hash) arrays of byte n-grams with no white space but at either end, slice by slice."""
        whole = len(self.data) - n + 1
        for start in range(0, whole, SLICE):
            size = min(SLICE, whole - start)
            space = self.space[start : start + size + n - 1]
            data = np.where(space, np.uint8(32), self.data[start : start + size + n - 1])
            inner = np.zeros(size, bool)
            h = np.full(size, 128 + n, np.uint64)
            for k in range(n):
                h ^= _TABLE[k][data[k : k + size]]
                if 0 < k < n - 1:
                    inner |= space[k : k + size]
            at = np.nonzero(~inner)[0]
            yield at + start, mixed(h[at])
