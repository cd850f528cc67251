"""Elias-Fano coding of ascending sequences, with select samples for reading single values (Elias 1974, Fano 1971).

A sequence of n values below u takes about 2 + log2(u / n) bits for each value: the low bits of each value as they
are, and the rest in unary, as a bit vector in which the i-th one stands at (value >> low) + i. The position of every
SAMPLE-th one is kept, so that one value is found by reading a few bytes; no table of 64-bit offsets exists.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QQBxxxIII")
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode(values: np.ndarray) -> bytes:
    """values: ascending unsigned 64-bit, repeats allowed."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    base = int(values[0]) if n else 0
    rest = values - np.uint64(base)
    top = int(rest[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    lows = (rest[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1) if low else np.zeros((n, 0))
    low_bytes = np.packbits(lows.astype(np.uint8).ravel(), bitorder="little").tobytes()
    ones = (rest >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    bits[ones] = 1
    high_bytes = np.packbits(bits, bitorder="little").tobytes()
    marks = ones[::SAMPLE].astype("<u4").tobytes()
    return _HEAD.pack(n, base, low, len(low_bytes), len(high_bytes), len(marks)) + low_bytes + high_bytes + marks


class EliasFano:
    """A coded sequence; seq[i] reads one value, all() reads every one."""

    def __init__(self, data: bytes):
        self.n, self.base, self.low, a, b, c = _HEAD.unpack_from(data)
        at = _HEAD.size
        self.lows = np.frombuffer(data, np.uint8, a, at)
        self.highs = np.frombuffer(data, np.uint8, b, at + a)
        self.marks = np.frombuffer(data, "<u4", c // 4, at + a + b)

    def __len__(self) -> int:
        return self.n

    def _select(self, i: int) -> int:
        """The position of the i-th one, from the sample before it."""
        at = int(self.marks[i // SAMPLE])
        left = i % SAMPLE
        byte = at // 8
        word = int(self.highs[byte]) & (0xFF << (at % 8))
        while (ones := int(_ONES[word])) <= left:
            left -= ones
            byte += 1
            word = int(self.highs[byte])
        for _ in range(left):
            word &= word - 1
        return byte * 8 + (word & -word).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        start = i * self.low
        piece = int.from_bytes(self.lows[start // 8 : (start + self.low + 7) // 8].tobytes(), "little") >> (start % 8)
        return self.base + ((self._select(i) - i) << self.low) + (piece & ((1 << self.low) - 1))

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            bits = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low].reshape(-1, self.low).astype(np.uint64)
            out |= (bits << np.arange(self.low, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out + np.uint64(self.base)
