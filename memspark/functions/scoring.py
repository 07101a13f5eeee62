"""Score expressions: trust, activation, similarity, corroboration."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SOURCE_TRUST, SOURCE_WEIGHTS, TRUST_RANKS


def mapped(c: Column, table: dict, other=None) -> Column:
    out = F
    for k, v in table.items():
        out = out.when(c == k, F.lit(v))
    return out.otherwise(F.lit(other))


def trust_rank(trust: Column, missing: str | None = "low") -> Column:
    """0 to 2; missing says what null counts as."""
    return mapped(F.coalesce(trust, F.lit(missing)) if missing else trust, TRUST_RANKS)


def trust_name(rank: Column) -> Column:
    return mapped(rank, {v: k for k, v in TRUST_RANKS.items()})


def source_trust(by: Column) -> Column:
    return mapped(by, SOURCE_TRUST, "low")


def source_weight(by: Column) -> Column:
    return mapped(by, SOURCE_WEIGHTS, 1)


def age_seconds(t: Column, now: Column) -> Column:
    """Seconds since an epoch-millisecond time, at least 1."""
    return F.greatest(F.lit(1.0), (now - t) / F.lit(1000.0))


def decayed(t: Column, now: Column, decay: float) -> Column:
    return F.pow(age_seconds(t, now), F.lit(-decay))


def compacted_sum(count: Column, first: Column, now: Column, decay: float) -> Column:
    """The sum of a run of evenly spaced presentations from its count and first time."""
    return F.when(count > 0, count / F.lit(max(1e-6, 1 - decay)) * decayed(first, now, decay)).otherwise(0.0)


def base_level(total: Column) -> Column:
    """Activation from the presentations' decayed sum; null if there was none."""
    return F.when(total > 0, F.log(total))


def retrieval_probability(base: Column, decay: float, threshold_days: float, noise: float) -> Column:
    """A logistic in the activation, one half for a single presentation threshold_days ago; 0 for null."""
    tau = -decay * math.log(max(1.0, threshold_days * 86_400))
    return F.coalesce(1.0 / (1.0 + F.exp(-(base - F.lit(tau)) / F.lit(noise))), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; an error where the lengths differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    same = F.when(F.size(a) != F.size(b), F.raise_error("vectors of different lengths"))
    return F.coalesce(same.cast("double"), F.when(norms > 0, dot(a, b) / norms).otherwise(0.0))


def support_confidence(weight: Column) -> Column:
    """Confidence of a claim with this weighted support."""
    return F.least(F.lit(1.0), 0.5 + 0.25 * F.greatest(F.lit(0.0), weight - 1.0))


def strengthened(conf: Column, by: Column) -> Column:
    return F.least(F.lit(1.0), conf + 0.125 * source_weight(by))


def salience(hops: Column, confidence: Column, activation: Column) -> Column:
    """Of an association: far notes, sure claims and active notes count more."""
    return F.least(hops, F.lit(6)) / F.lit(6.0) * confidence * activation
