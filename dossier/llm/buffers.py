"""Words, lines and hashes of a whole Arrow batch of texts at once, in numpy. Texts end in a newline (common.lines)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of texts that are worked on together.
CHUNK = 1 << 18
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240229)
CODES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_CODES = CODES[LOWER]
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    had = _powers.get(base)
    if had is None or len(had) < n:
        with np.errstate(over="ignore"):
            had = _powers[base] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, CHUNK + 1) - 1, base, np.uint64)])
    return had[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that leaves no pattern of sums."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and where each value begins (one more: the end)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    at = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32, len(col) + 1, col.offset * (8 if wide else 4)).astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[at[0] : at[-1]] if len(col) and col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def pieces(at: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about limit bytes."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j
        i = j


def hashed_runs(data: np.ndarray, begin: np.ndarray, end: np.ndarray, codes: np.ndarray = CODES) -> np.ndarray:
    """A 64-bit hash of data[b:e] for each b, e: differences of one running sum, shifted to position 0."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(codes[data] * powers(BASE, len(data)), out=sums[1:])
        return mix((sums[end] - sums[begin]) * powers(INVERSE, len(data) + 1)[begin] + (end - begin).astype(np.uint64))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word; data ends in a space."""
    space = SPACES[data]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        edge = np.r_[0, edge]
    return edge[::2], edge[1::2]


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of each n neighbours in their order."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
        for k in range(n):
            out += hashes[k : k + len(out)] * np.uint64(pow(BASE, 2 * k + 3, 1 << 64))
        return mix(out)


def repeated(keys: np.ndarray) -> np.ndarray:
    """For each key, whether it stands in keys twice or more."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def later(keys: np.ndarray) -> np.ndarray:
    """For each key, whether an earlier one equals it."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    out = np.zeros(len(keys), bool)
    out[order[1:][s[1:] == s[:-1]]] = True
    return out
