"""Vectorised work on the bytes of many texts at once (numpy, inside tasks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03))
_BYTE_LOWER = _BYTE[_LOWER]
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept for the worker's later batches."""
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _powers[:] = []
        for base in (_BASE, _BASE_INV):
            row = np.full(size, base, U)
            row[0] = 1
            _powers.append(np.cumprod(row, dtype=U))
    return _powers[0], _powers[1]


def slices(sizes: list[int], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes add up to about `limit` at most (one item at least)."""
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def flatten(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one byte array, each followed by one space, and where each begins."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return buf, starts


def prefix_hash(buf: np.ndarray, lower: bool = False) -> np.ndarray:
    """H with H[j] - H[i] = sum of value(byte k) * base**k for i <= k < j."""
    pw, _ = powers(len(buf) + 1)
    out = np.zeros(len(buf) + 1, U)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[buf] * pw[: len(buf)], out=out[1:])
    return out


def spans_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever the span's bytes stand."""
    _, inv = powers(len(prefix))
    return mix((prefix[end] - prefix[begin]) * inv[begin])


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (A-Z as a-z), the first word of each text, its bytes' ends.

    Words are runs without the bytes 0x20 and 0x09 to 0x0D. Returns hashes, `first` (one more than
    the texts) and the byte spans as an (n, 2) array over `flatten(texts)`.
    """
    buf, starts = flatten(texts)
    gap = SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).astype(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    hashes = spans_hash(prefix_hash(buf, lower=True), begin, end)
    return hashes, np.searchsorted(begin, starts), np.stack((begin, end), axis=1)


_WORD_AT = mix(np.arange(1, 65, dtype=U) * U(0xA24BAED4963EE407)) | U(1)


def shingles(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """Per text its sorted distinct n-word shingle hashes; fewer words: the sequence as one; none: empty."""
    hashes, first, _ = words(texts)
    rolled = np.zeros(max(0, len(hashes) - n + 1), U)
    for k in range(n):
        rolled += hashes[k : k + len(rolled)] * _WORD_AT[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            short = (hashes[a:b] * _WORD_AT[: b - a]).sum(dtype=U) + U(b - a)
            out.append(mix(np.array([short], U)))
        else:
            out.append(np.zeros(0, U))
    return out
