"""Elias-Fano codes of ascending integers.

n values below u are split into l = floor(log2(u / n)) low bits, packed one after the
other, and high parts, written in unary: bit (value >> l) + i of a bit string is set for
value i. That takes about 2 + log2(u / n) bits a value. ``select(i)`` finds the i-th set
bit: every ``EVERY`` set bits a 32-bit sample of its place is kept, and from there bytes
are counted by a table. No table of 64-bit values is kept or built."""

from __future__ import annotations

import struct
import sys

import numpy as np
from pyspark import cloudpickle

EVERY = 512
HEAD = "<QQB7xQQQ"  # n, u, low bits, bytes of low bits, of high bits, of samples
BLOCK = 1 << 16
_COUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def _pack(low: np.ndarray, bits: int) -> bytes:
    """``low`` in ``bits`` bits each, least significant bit first; blocks are whole bytes."""
    out = []
    for i in range(0, len(low), BLOCK):
        part = low[i:i + BLOCK]
        spread = ((part[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
        out.append(np.packbits(spread.ravel(), bitorder="little").tobytes())
    return b"".join(out)


def encode(values: np.ndarray, universe: int) -> bytes:
    """The code of ascending uint64 values below ``universe``."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    bits = max(0, (universe // n).bit_length() - 1) if n else 0
    low = _pack(v & np.uint64((1 << bits) - 1), bits) if bits else b""
    ones = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n, dtype=np.int64)
    length = int(ones[-1]) + 1 if n else 0
    if length >= 1 << 32:
        raise ValueError("more than 2^32 bits of high parts; write smaller files")
    high = np.zeros(-(-length // 8), np.uint8)
    np.bitwise_or.at(high, ones >> 3, (1 << (ones & 7)).astype(np.uint8))
    samples = ones[::EVERY].astype("<u4")
    return struct.pack(HEAD, n, universe, bits, len(low), len(high), samples.nbytes) + low + high.tobytes() + samples.tobytes()


class EliasFano:
    """Random access to a code."""

    def __init__(self, code: bytes):
        self.n, self.universe, self.bits, a, b, c = struct.unpack_from(HEAD, code)
        data = np.frombuffer(code, np.uint8, a + b + c, struct.calcsize(HEAD))
        self._low, self._high = data[:a], data[a:a + b]
        self._samples = data[a + b:].view("<u4") if c else np.zeros(0, "<u4")

    def __len__(self) -> int:
        return self.n

    def _ones(self, start: int, stop: int) -> np.ndarray:
        """Places of the set bits number start to stop - 1."""
        first = start // EVERY
        at = int(self._samples[first]) >> 3  # the byte of the sampled bit
        seen = first * EVERY - int(_COUNT[self._high[at] & ((1 << (int(self._samples[first]) & 7)) - 1)])
        after = -(-stop // EVERY)
        end = int(self._samples[after]) // 8 + 1 if after < len(self._samples) else len(self._high)
        places = np.flatnonzero(np.unpackbits(self._high[at:end], bitorder="little"))
        return places[start - seen:stop - seen] + 8 * at

    def _lows(self, start: int, stop: int) -> np.ndarray:
        out = np.zeros(stop - start, np.uint64)
        if not self.bits:
            return out
        size = BLOCK * self.bits // 8
        for block in range(start // BLOCK, -(-stop // BLOCK)):
            a, b = max(start, block * BLOCK), min(stop, (block + 1) * BLOCK)
            first = (a - block * BLOCK) * self.bits
            last = (b - block * BLOCK) * self.bits
            spread = np.unpackbits(self._low[block * size + first // 8:block * size + -(-last // 8)], bitorder="little")
            spread = spread[first % 8:first % 8 + last - first].reshape(b - a, self.bits).astype(np.uint64)
            out[a - start:b - start] = (spread << np.arange(self.bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    def range(self, start: int, stop: int) -> np.ndarray:
        """Values number start to stop - 1 as uint64."""
        start, stop = max(0, start), min(stop, self.n)
        if start >= stop:
            return np.zeros(0, np.uint64)
        high = (self._ones(start, stop) - np.arange(start, stop)).astype(np.uint64)
        return (high << np.uint64(self.bits)) | self._lows(start, stop)

    def select(self, i: int) -> int:
        """Value number i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.range(i, i + 1)[0])


cloudpickle.register_pickle_by_value(sys.modules[__name__])
