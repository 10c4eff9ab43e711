"""Vectorised text primitives for Arrow batches: words, rolling hashes, shingles.

A batch of texts is laid out as one byte array, each text followed by a separator byte, so that words,
hashes and n-grams of thousands of texts come from a few numpy passes. Memory is bounded by ``limit``
bytes of text at a time (or by one text, if that is longer).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

LIMIT = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C55)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: list[np.ndarray] = []


def texts(column: pa.Array, limit: int = LIMIT) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first row, texts as UTF-8 bytes; null as empty), about ``limit`` bytes at a time."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    first, held, size = 0, [], 0
    for i, x in enumerate(column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())):
        x = x.as_py() or b""
        if held and size + len(x) > limit:
            yield first, held
            first, held, size = i, [], 0
        held.append(x)
        size += len(x)
    if held:
        yield first, held


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        m = max(n, LIMIT + (1 << 16))
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m - 1, b, np.uint64))]) for b in (BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Block:
    """Some texts side by side: bytes (A-Z lower-cased on request) and where each begins."""

    def __init__(self, held: list[bytes], lower: bool = True):
        self.data = np.frombuffer(b"\n".join(held) + b"\n", np.uint8)
        if lower:
            self.data = LOWER[self.data]
        self.lengths = np.fromiter(map(len, held), np.int64, len(held))
        self.begins = np.concatenate([[0], np.cumsum(self.lengths + 1)])  # one more than texts

    def prefix(self) -> np.ndarray:
        """prefix[e] - prefix[s] is the polynomial hash of bytes s..e-1, times BASE**s."""
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers(len(self.data))[0][: len(self.data)], out=out[1:])
        return out

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begins and ends of all words, and per text the number of the first word (one more than texts)."""
        gap = SEPARATOR[self.data]
        before = np.concatenate([[True], gap[:-1]])
        begins = np.flatnonzero(before & ~gap)
        ends = np.flatnonzero(gap & ~before)
        return begins, ends, np.searchsorted(begins, self.begins)

    def spans(self, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes from each begin to each end."""
        p = self.prefix()
        return mix((p[ends] - p[begins]) * _powers(len(self.data))[1][begins] + (ends - begins).astype(np.uint64))

    def word_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit hash of each word; per text the number of the first word (one more than texts)."""
        begins, ends, first = self.words()
        return self.spans(begins, ends), first


_WEIGHTS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(block: Block, k: int = 5) -> list[np.ndarray]:
    """Per text, the sorted distinct 64-bit hashes of its k-word shingles.

    Fewer than k words: the whole sequence as one shingle. No word: an empty set.
    """
    w, first = block.word_hashes()
    if len(w) >= k:
        n = len(w) - k + 1
        rolled = np.zeros(n, np.uint64)
        for j in range(k):
            rolled += w[j : j + n] * _WEIGHTS[j]
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            s = np.sort(rolled[a : b - k + 1].view(np.int64))
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif b > a:
            with np.errstate(over="ignore"):
                h = (w[a:b] * _WEIGHTS[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([h], np.uint64)).view(np.int64))
        else:
            out.append(np.zeros(0, np.int64))
    return out
