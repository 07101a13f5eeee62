"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, everything but letters becomes one space, and the 1- to 3-grams of characters are
hashed into DIMS features; a feature weighs (1 + ln tf) * idf, and vectors have length 1. Document
frequencies cover every training text. The weights are fitted on the driver on a bounded sample of
labelled rows - the PER_LANG documents of each language whose ids hash lowest - by follow-the-
regularised-leader (FTRL-proximal, McMahan et al. 2013) with L1 and L2 penalties, which leaves most of
them at exactly zero. A fifth of the sample is left out of the fit and sets the softmax temperature by
maximum likelihood.

Rows of the sample travel as features, at most DIMS of them, so a very long text costs no more than that;
texts are always read whole. The model is DIMS x languages numbers, whatever the corpus.

Defined results: `und` with score 0 for null texts and texts with no letter, and for all if there was nothing
to learn from; rows without a language or an id teach nothing; equal rows are judged each; ties go to the
first language by name; extra columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import annotate, in_slices

BITS = 14
DIMS = 1 << BITS
GRAMS = 3
PER_LANG = 800
EPOCHS, ALPHA, BETA, L1, L2 = 4, 1.0, 1.0, 0.02, 0.1
UNKNOWN = "und"
U64 = np.uint64


@lru_cache(1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and counts of a text; none if it has no letter."""
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    if not text:
        return none
    c = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    full = letters()[c]
    if not full.any():
        return none
    c = np.where(full, c, 32)
    keep = full.copy()
    keep[0] = True
    keep[1:] |= full[:-1]
    c = c[keep].astype(U64)
    counts = np.zeros(DIMS, dtype=np.int64)
    gram = np.zeros(len(c), dtype=U64)
    for n in range(GRAMS):
        if len(c) <= n:
            break
        gram = gram[: len(c) - n] * U64(0x110000) + c[n:]
        counts += np.bincount((K.mix(gram, n) >> U64(64 - BITS)).astype(np.int64), minlength=DIMS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.ones(DIMS, dtype=np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((DIMS, 0), dtype=np.float32))
    temperature: float = 1.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        x = (1 + np.log(counts)) * self.idf[at]
        return x / max(np.sqrt((x * x).sum()), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = features(text)
        if not len(at) or not self.langs:
            return UNKNOWN, 0.0
        p = softmax(self.vector(at, counts) @ self.weights[at] / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from learning: the CRC-32 of its id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each feature occurs, and the number of texts with a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(DIMS, dtype=np.int64), 0
        for batch in batches:
            for part in in_slices(batch, "text", 4 << 20):
                for t in part.column("text").to_pylist():
                    at, _ = features(t)
                    df[at] += 1
                    n += len(at) > 0
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int64()), pa.array([*df[at], n], pa.int64())], names=["feature", "n"])

    got = train.select("text").mapInArrow(run, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()  # at most DIMS + 1 rows
    found = {r["feature"]: r["n"] for r in got}
    out = np.zeros(DIMS, dtype=np.int64)
    for f, n in found.items():
        if f >= 0:
            out[f] = n
    return out, found.get(-1, 0)


def sample(train: DataFrame, per_lang: int) -> list:
    """For each language the per_lang documents whose ids hash lowest: (lang, features, counts), in hash order."""
    sizes = {r["lang"]: r["count"] for r in train.groupBy("lang").count().collect()}
    if not sizes:
        return []
    # A cut by hash drops most rows where they are read; the rank makes the bound strict.
    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 1.3 * per_lang / n + 100 / n))])
    spot = F.col("spot") / F.lit(float(1 << 62)) / 4 + 0.5
    cut = train.withColumn("spot", F.xxhash64("id")).filter(spot <= rate[F.col("lang")])
    few = cut.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("spot", "id"))).filter(F.col("nth") <= per_lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("spot"), pa.array([a.astype("<u2").tobytes() for a, _ in got]), pa.array([c.astype("<u4").tobytes() for _, c in got])], names=["lang", "spot", "at", "counts"]
            )

    rows = few.select("lang", "spot", "text").mapInArrow(run, "lang string, spot bigint, at binary, counts binary").collect()
    rows.sort(key=lambda r: (r["spot"], r["lang"]))
    return [(r["lang"], np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["counts"], "<u4").astype(np.int64)) for r in rows if len(r["at"])]


def ftrl(examples: list[tuple[int, np.ndarray, np.ndarray]], n_langs: int) -> np.ndarray:
    """Weights by FTRL-proximal with an elastic net; examples are (language, features, values)."""
    z, n = np.zeros((DIMS, n_langs)), np.zeros((DIMS, n_langs))

    def active(at: np.ndarray) -> np.ndarray:
        mine = z[at]
        shrunk = np.sign(mine) * np.maximum(np.abs(mine) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for lang, at, x in examples:
            w = active(at)
            p = softmax(x @ w)
            p[lang] -= 1
            g = x[:, None] * p[None, :]
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
            n[at] = new
    return active(np.arange(DIMS)).astype(np.float32)


def best_temperature(logits: np.ndarray, langs: np.ndarray) -> float:
    """The temperature of the highest likelihood, by golden section over its logarithm."""
    if not len(langs):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(logits / math.exp(log_t))
        return float(-np.log(np.maximum(p[np.arange(len(langs)), langs], 1e-12)).mean())

    low, high, ratio = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def fit(train: DataFrame, per_lang: int = PER_LANG) -> Model:
    """A model from rows (id, text, lang); rows with a null are left out. Its order of rows doesn't matter."""
    train = train.filter("id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    rows = sample(train, per_lang)
    if not rows:
        return Model()
    df, n = document_frequencies(train)
    langs = sorted({lang for lang, _, _ in rows})
    model = Model(langs, (np.log((1 + n) / (1 + df)) + 1).astype(np.float32))
    number = {lang: i for i, lang in enumerate(langs)}
    data = [(number[lang], at, model.vector(at, counts)) for lang, at, counts in rows]
    left_out = data[::5] if len(data) >= 10 else []
    model.weights = ftrl([d for i, d in enumerate(data) if i % 5 or not left_out], len(langs))
    model.temperature = best_temperature(np.array([x @ model.weights[at] for _, at, x in left_out]), np.array([lang for lang, _, _ in left_out], dtype=np.int64))
    return model


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, text: str = "text") -> tuple[DataFrame, str]:
    """docs with a struct of lang_pred and score; also the struct's name."""

    def run(col: pa.Array) -> dict[str, object]:
        got = [model.predict(t) for t in col.to_pylist()]
        return {"lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64())}

    return annotate(docs, run, "lang_pred string, score double", "language", keep, text, slice_bytes=4 << 20)
