"""Vectorised text work on Arrow string columns, used inside tasks.

Words are runs of bytes outside ``\\x20 \\x09-\\x0D``. A column is walked in blocks of about
``BLOCK`` bytes (or one text, if it is longer), so that the temporary arrays stay small whatever
the batch holds. All hashes are fixed functions of the bytes: they agree between reruns and machines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
BLOCK = 1 << 20


def splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudorandom 64-bit integers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_table(seed: int, lower: bool, space: np.ndarray = IS_SPACE) -> np.ndarray:
    """A random value for each byte; 0 for the space bytes; A-Z as a-z if asked for."""
    t = splitmix(256, seed)
    if lower:
        t = t[LOWER]
    t[space] = 0
    return t


def powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, U64)
    p[0] = 1
    return np.multiply.accumulate(p)


POWERS = {s: powers(b, 4096) for s, b in ((0, 0x9E3779B97F4A7C15 | 1), (1, 0xD1342543DE82EF95))}
BASES = {0: 0x9E3779B97F4A7C15 | 1, 1: 0xD1342543DE82EF95}


@dataclass
class Block:
    """Rows lo to hi of a column. bytes: their UTF-8, end to end; row i has bytes[at[i]:at[i + 1]]."""

    lo: int
    hi: int
    bytes: np.ndarray
    at: np.ndarray

    def words(self, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word in bytes, and the number of words before each row (one more entry than rows)."""
        solid = ~space[self.bytes]
        n = len(solid)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, np.zeros(self.hi - self.lo + 1, np.int64)
        first = np.zeros(n + 1, bool)
        first[: len(self.bytes)] = solid
        first[1:n] &= ~solid[:-1]
        at = self.at[:-1]
        at = at[at < n]
        first[at] = np.where(solid[at], True, first[at])
        first[n] = False
        starts = np.flatnonzero(first)
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        ends_at = self.at[1:]
        ends_at = ends_at[ends_at > 0] - 1
        last[ends_at] = np.where(solid[ends_at], True, last[ends_at])
        ends = np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(starts, self.at).astype(np.int64)

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0, space: np.ndarray = IS_SPACE, prefix: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, or of its first `prefix` bytes."""
        if not len(starts):
            return np.zeros(0, U64)
        gap = np.zeros(len(self.bytes), np.int64)
        gap[starts[0]] = starts[0]
        gap[starts[1:]] = np.diff(starts)
        place = np.arange(len(self.bytes), dtype=np.int64) - np.cumsum(gap)
        place[: starts[0]] = 0
        table, power, widest = byte_table(0x51ED + seed, lower, space), POWERS[seed & 1], int((ends - starts).max())
        if widest >= len(power):
            power = powers(BASES[seed & 1], widest + 1)
        values = table[self.bytes]
        values *= power[np.minimum(place, widest)]
        size = ends - starts
        if prefix:
            values[place >= prefix] = 0
            size = np.minimum(size, prefix)
        return mix(np.add.reduceat(values, starts) + size.astype(U64))


def blocks(column: pa.Array) -> Iterator[Block]:
    """The column in blocks; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2] if n else None
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK, "right")) - 1)
        yield Block(lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def windows(hashes: np.ndarray, before: np.ndarray, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words inside one row, and the index of its first word."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    factors = splitmix(k, 0xABCD + seed) | U64(1)
    total = hashes[: n - k + 1] * factors[0]
    for j in range(1, k):
        total = total + hashes[j : n - k + 1 + j] * factors[j]
    ok = np.ones(n - k + 1, bool)
    for b in range(1, k):  # a run that begins fewer than k words before a row's end crosses it
        cut = before[1:] - b
        ok[cut[(cut >= 0) & (cut < len(ok))]] = False
    first = np.flatnonzero(ok)
    # rows shorter than k leave starts of earlier rows marked as well, so what is left lies in one row
    return mix(total[first]), first


def per_row(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sum of values of each row, where row i has values[before[i]:before[i + 1]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[before[1:]] - total[before[:-1]]
