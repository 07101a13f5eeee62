"""NumPy kernels over the UTF-8 bytes of an Arrow text column.

Everything here is a pure function of the bytes, so a lost task gives the same rows again. Words are
cut at ASCII white space. Hashes are 64-bit polynomial hashes (prefix sums times inverse powers of an
odd base, modulo 2**64) finished with an avalanche step; sequences are hashed the same way over their
words' hashes, so a window costs O(1) whatever its width.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASES = (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(10, (n - 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            p = np.full(size, b, dtype=U64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=U64))
        _powers[base] = have = (out[0], out[1])
    return have


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """An avalanche of 64 bits (the finaliser of splitmix64)."""
    x = x + U64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def ranges_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each range, independent of where the range stands."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values.astype(U64, copy=False) * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts]) ^ (ends - starts).astype(U64)


@dataclass
class Words:
    """The words of a batch of texts: byte ranges, the text each belongs to, and each text's first word."""

    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def hashes(self, fold: bool = False) -> np.ndarray:
        data = LOWER[self.data] if fold else self.data
        return ranges_hash(data.astype(U64) + U64(1), self.start, self.end, BYTE_BASE)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string or binary column; null is empty."""
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def words_of(col: pa.Array) -> Words:
    data, bounds = text_bytes(col)
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, bounds, none, none, none, np.zeros(len(bounds), dtype=np.int64))
    full = ~SPACE[data]
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = full[:-1]
    edges = bounds[:-1]
    before[edges[edges < n]] = False
    start = np.flatnonzero(full & ~before)
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = full[1:]
    tails = bounds[1:] - 1
    after[tails[tails >= 0]] = False
    end = np.flatnonzero(full & ~after) + 1
    doc = np.searchsorted(bounds, start, side="right") - 1
    first = np.searchsorted(start, bounds, side="left")
    return Words(data, bounds, start, end, doc, first)


def windows(hashes: np.ndarray, doc: np.ndarray, k: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every window of k words that stays within its text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return at, ranges_hash(hashes, at, at + k, base)


def covered(n: int, starts: np.ndarray, k: int | np.ndarray) -> np.ndarray:
    """Which of n places lie in a range [start, start + k)."""
    change = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + k, n), minlength=n + 1)
    return np.cumsum(change[:n]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
