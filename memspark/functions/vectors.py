"""Vectors from text without a model: hashed character trigrams."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The 32-bit hash's start and prime, and the vectors' length.
HASH_START, HASH_PRIME = 2166136261, 16777619
DIM = 256


def hashes(text: str, n: int = 3) -> np.ndarray:
    """FNV-1a of every n UTF-16 units of a text, all at once."""
    units = np.frombuffer(text.encode("utf-16-le"), dtype="<u2").astype(np.uint64)
    count = max(len(units) - n + 1, 0)
    h = np.full(count, HASH_START, dtype=np.uint64)
    for k in range(n):
        h = ((h ^ units[k : k + count]) * np.uint64(HASH_PRIME)) & np.uint64(0xFFFFFFFF)
    return h


def embed(text: str | None, dim: int = DIM) -> list[float]:
    """Signed counts of the padded, lower-case text's trigrams by hash, of length 1; zeros for an empty text."""
    squeezed = " ".join((text or "").lower().split())
    h = hashes(f" {squeezed} ") if squeezed else np.zeros(0, dtype=np.uint64)
    sign = np.where((h >> np.uint64(31)) & np.uint64(1), -1.0, 1.0)
    v = np.bincount((h % np.uint64(dim)).astype(np.int64), weights=sign, minlength=dim)
    norm = np.sqrt(v @ v)
    return (v / norm if norm > 0 else v).astype(np.float32).tolist()


def trigram_embedding(text: Column, dim: int = DIM) -> Column:
    @F.pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda t: embed(t, dim))

    return run(text)
