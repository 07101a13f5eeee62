"""Quality rules from compression: zstandard ratios of whole texts and of fixed chunks must lie in a band.

A text that compresses too well repeats itself; one that hardly compresses is noise. Both limits depend
on the length, since a compressor needs context: the upper one grows with the logarithm of the length,
the lower one is a short table. A text is rejected when its whole ratio is out of its band, or when
chunks with over CHUNK_SHARE of its bytes are out of theirs.

Defined results: a null or empty text has no words, fails the base rule and isn't kept; very long texts
are read whole; repeated rows are judged each by itself; an empty table gives an empty table; extra
columns pass through, and a column named like the result's struct makes it take a free name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import kernels as K
from .common import annotate

LEVEL = 3
CHUNK = 4096
CHUNK_SHARE = 0.3
#: The upper limit is this at 400 bytes, and grows by UPPER_STEP at each doubling, up to UPPER_MOST.
UPPER_AT_400, UPPER_STEP, UPPER_MOST = 2.2, 0.2, 4.0
#: Least ratio from so many bytes on; shorter texts have no lower limit.
LOWER = ((200, 1.0), (400, 1.15), (800, 1.35), (3200, 1.45))
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30

FIELDS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, whole_ratio double, worst_chunk_ratio double, odd_chunk_bytes bigint, kept boolean"
)


def band(n_bytes: int) -> tuple[float, float]:
    """The ratios allowed at this length."""
    upper = UPPER_AT_400 + UPPER_STEP * max(0.0, math.log2(max(n_bytes, 1) / 400))
    lower = 0.0
    for least, limit in LOWER:
        if n_bytes >= least:
            lower = limit
    return lower, min(upper, UPPER_MOST)


def per_text(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    s = np.sort(keys)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    return twice[at] == keys


def base_metrics(col: pa.Array) -> dict[str, np.ndarray]:
    w = K.words_of(col)
    n = len(col)
    n_words = np.diff(w.first)
    full = ~K.SPACE[w.data]
    word_chars = per_text(full & ((w.data & 0xC0) != 0x80), w.bounds)
    n_symbols = per_text(SYMBOLS[w.data], w.bounds)

    breaks = np.flatnonzero(w.data == 10)
    start = np.unique(np.concatenate([w.bounds[:-1], breaks + 1]))
    # A break that ends a text starts an empty line there, which holds no word and so never counts.
    start = start[start < len(w.data)]
    end = np.append(start[1:], len(w.data)) if len(start) else start
    trimmed = end - (w.data[end - 1] == 10) if len(start) else end
    words_before = np.zeros(len(w.data) + 1, dtype=np.int64)
    np.cumsum(full, out=words_before[1:])
    some = words_before[trimmed] > words_before[start]
    start, trimmed = start[some], trimmed[some]
    line_doc = np.searchsorted(w.bounds, start, side="right") - 1
    keys = K.ranges_hash(w.data.astype(K.U64) + K.U64(1), start, trimmed, K.BYTE_BASE) ^ K.mix(line_doc.astype(K.U64))
    _, firsts = np.unique(keys, return_index=True)
    n_dup = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[firsts], minlength=n)

    at, h = K.windows(w.hashes(), w.doc, WINDOW, K.WORD_BASES[0])
    twice = repeated(h ^ K.mix(w.doc[at].astype(K.U64)))
    n_repeat = per_text(K.covered(len(w.doc), at[twice], WINDOW), w.first)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup, "n_repeat_words": n_repeat, "base_failed": failed}


def compression(col: pa.Array) -> dict[str, np.ndarray]:
    data, bounds = K.text_bytes(col)
    raw = memoryview(np.ascontiguousarray(data))
    packer = zstandard.ZstdCompressor(level=LEVEL)
    n = len(col)
    whole, worst, odd = np.ones(n), np.ones(n), np.zeros(n, dtype=np.int64)
    verdict = np.ones(n, dtype=bool)
    for i in range(n):
        a, b = int(bounds[i]), int(bounds[i + 1])
        if a == b:
            verdict[i] = False
            continue
        whole[i] = (b - a) / len(packer.compress(raw[a:b]))
        lower, upper = band(b - a)
        good = lower <= whole[i] <= upper
        if b - a > CHUNK:
            distance = -1.0
            for c in range(a, b, CHUNK):
                size = min(CHUNK, b - c)
                ratio = size / len(packer.compress(raw[c : c + size]))
                low, high = band(size)
                off = max(low - ratio, ratio - high)
                if off > 0:
                    odd[i] += size
                if off > distance:
                    distance, worst[i] = off, ratio
            good = good and odd[i] <= CHUNK_SHARE * (b - a)
        else:
            worst[i] = whole[i]
            odd[i] = 0 if good else b - a
        verdict[i] = good
    return {"whole_ratio": whole, "worst_chunk_ratio": worst, "odd_chunk_bytes": odd, "kept": verdict}


def measure(col: pa.Array) -> dict[str, np.ndarray]:
    out = base_metrics(col) | compression(col)
    out["kept"] = out["kept"] & ~out["base_failed"]
    return out


def quality_rules(docs: DataFrame, keep: list[str] | None = None, text: str = "text") -> tuple[DataFrame, str]:
    """docs with a struct of the measures and the verdict `kept`; also the struct's name."""
    return annotate(docs, measure, FIELDS, "quality", keep, text)
