"""Golomb coding with power-of-two parameters for sorted unsigned integers, in NumPy."""

from __future__ import annotations

import numpy as np


def encode(values: np.ndarray, width: int) -> bytes:
    """Sorted distinct values below 2**width, as gaps: unary quotients, then fixed-width remainders.

    The parameter is the one that fits the mean gap; it and the count stand in front. Empty input gives a header alone.
    """
    n = len(values)
    if not n:
        return bytes(5)
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    k = max(0, min(63, int(np.log2(max(1.0, float(values[-1]) / n)))))
    ends = np.cumsum((gaps >> np.uint64(k)).astype(np.int64) + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    low = np.empty((n, k), np.uint8)
    for bit in range(k):
        low[:, bit] = (gaps >> np.uint64(bit)) & np.uint64(1)
    return n.to_bytes(4, "little") + bytes([k]) + np.packbits(unary).tobytes() + np.packbits(low.ravel()).tobytes()


def decode(data: bytes) -> np.ndarray:
    n, k = int.from_bytes(data[:4], "little"), data[4]
    if not n:
        return np.empty(0, np.uint64)
    body = np.frombuffer(data, np.uint8, offset=5)
    tail = (n * k + 7) // 8
    ends = np.flatnonzero(np.unpackbits(body[: len(body) - tail]))[:n] + 1
    gaps = (np.diff(ends, prepend=0) - 1).astype(np.uint64) << np.uint64(k)
    if k:
        low = np.unpackbits(body[len(body) - tail :])[: n * k].reshape(n, k)
        for bit in range(k):
            gaps |= low[:, bit].astype(np.uint64) << np.uint64(bit)
    return np.cumsum(gaps, dtype=np.uint64)
