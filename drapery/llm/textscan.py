"""Words of many texts as arrays of 64-bit hashes (numpy, used inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32  # A-Z
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BACK = pow(int(_BASE), -1, 2**64)
_BYTE[_GAP] = 0  # what separates words adds nothing to them
SLICE = 1 << 17
KEEP = 1 << 20
BLOCK_BYTES = 2 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base % 2**64, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_kept: dict[int, np.ndarray] = {}


def kept_powers(base: int, n: int) -> np.ndarray:
    """:func:`powers`, remembered up to ``KEEP`` of them."""
    if n > KEEP:
        return powers(base, n)
    if base not in _kept or len(_kept[base]) < n:
        _kept[base] = powers(base, min(KEEP, 1 << max(0, n - 1).bit_length()))
    return _kept[base][:max(n, 1)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Words:
    """Words of a block of texts: ``hash`` per word, ``first[i]:first[i+1]`` are text i's."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        self.data = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(self.data, np.uint8)
        if lower:
            buf = _LOWER[buf]
        gap = _GAP[buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if not gap[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)
        self.hash = self._hash(buf)

    def _hash(self, buf: np.ndarray) -> np.ndarray:
        """Per word the sum of its bytes' values times powers that count from the word's begin: summed over
        the slice's powers, then taken back by the power at the begin."""
        n = len(self.start)
        out = np.empty(n, np.uint64)
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.start, self.start[i] + SLICE)))
            begin = self.start[i:j] - self.start[i]
            value = _BYTE[buf[self.start[i]:self.end[j - 1]]]
            value *= kept_powers(int(_BASE), len(value))
            out[i:j] = np.add.reduceat(value, begin) * kept_powers(_BACK, int(begin[-1]) + 1)[begin]
            i = j
        return mix(out + (self.end - self.start).astype(np.uint64))

    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def slice_bytes(self, i: int, j: int) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.start[i:j].tolist(), self.end[i:j].tolist())]


class Grams:
    """Hashes of runs of consecutive words, by prefix sums."""

    def __init__(self, hashes: np.ndarray, salt: int = 0):
        base = (0xD1342543DE82EF95 + 2 * 0x632BE59BD9B4E019 * salt) | 1
        h = mix(hashes + U((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64))
        n = len(h)
        self.sum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * kept_powers(base, n)[:n], dtype=np.uint64)])
        self.back = kept_powers(pow(base, -1, 2**64), n + 1)

    def at(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sum[stop] - self.sum[start]) * self.back[start])


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
