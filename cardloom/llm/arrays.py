"""Words of many texts at once, as NumPy arrays over one byte buffer."""

from __future__ import annotations

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n; kept and grown on demand."""
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base & (2**64 - 1), U)
        got[0] = 1
        _POWERS[base] = got = np.multiply.accumulate(got)
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class RangeHash:
    """Hashes of any ranges of one sequence from prefix sums of a polynomial modulo 2**64.

    Equal ranges have equal hashes; unequal ones may too, so callers that decide anything compare the ranges as well.
    """

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, U)
        np.cumsum((values.astype(U) + U(1)) * powers(_BASE, n), out=self.sums[1:])
        self.inverse = powers(pow(_BASE, -1, 2**64), n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U))


class Words:
    """Words of texts whose white space is already single spaces, `starts` and `ends` in `data`; word i belongs to text `doc[i]`."""

    def __init__(self, normal: list[bytes]):
        self.data = b"\n" + b"\n".join(normal) + b"\n"
        self.bytes = np.frombuffer(self.data, np.uint8)
        line = self.bytes == 10
        seps = np.flatnonzero(line | (self.bytes == 32))
        real = np.flatnonzero(np.diff(seps) > 1)
        self.starts = seps[real] + 1
        self.ends = seps[real + 1]
        self.doc = np.cumsum(line[seps])[real] - 1
        #: Words before each text, and of all at the end.
        self.first = np.searchsorted(self.doc, np.arange(len(normal) + 1))

    def codes(self, block: int = 1 << 16) -> np.ndarray:
        """A hash of every word; a block of words at a time, so that the byte-wise arrays stay small."""
        out = np.empty(len(self.starts), U)
        for i in range(0, len(out), block):
            s, e = self.starts[i : i + block], self.ends[i : i + block]
            low = s[0]
            out[i : i + block] = RangeHash(self.bytes[low : e[-1]])(s - low, e - low)
        return out


def normal(text: bytes) -> bytes:
    """The words `[^\\x20\\x09-\\x0D]+` of a text joined by one space."""
    return b" ".join(text.split())


def spans(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each c, one after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
