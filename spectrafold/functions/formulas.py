"""Formulas as column expressions: probabilities, weights, inverse document frequencies, entropy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def smoothed(c: Column, total: Column, alpha: float | Column, vocabulary: Column) -> Column:
    """(c + alpha) / (total + alpha * vocabulary)."""
    alpha = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    return (c + alpha) / (total + alpha * vocabulary)


def idf(df: Column, samples: Column, strict: bool = False) -> Column:
    """ln((N + 1) / (df + 1)) + 1, or ln(N / df) if strict."""
    return F.log(samples / df) if strict else F.log((samples + 1) / (df + 1)) + 1


def binary_entropy(f: Column) -> Column:
    """-f log2 f - (1 - f) log2 (1 - f), 0 at 0 and 1."""
    inner = -f * F.log2(f) - (1 - f) * F.log2(1 - f)
    return F.when((f > 0) & (f < 1), inner).otherwise(0.0)


def weight(g: Column, kind: str) -> Column:
    """Weight of a feature by its global probability."""
    return {"one": F.lit(1.0), "neglog": -F.log(g), "inverse": 1.0 / g, "inverse_sqrt": 1.0 / F.sqrt(g)}[kind]


def length_factor(a: Column, b: Column) -> Column:
    """max(0, 1 - |a - b| / mean), 0 if the mean is 0."""
    mean = (a + b) / 2.0
    return F.when(mean > 0, F.greatest(F.lit(0.0), 1 - F.abs(a - b) / mean)).otherwise(0.0)


def status(score: Column, clear_above: float = 0.10, middle: str = "weak/ambiguous") -> Column:
    """What a silhouette says of a sample."""
    named = F.when(score > clear_above, "clear").when(score >= 0, middle).otherwise("possibly_misplaced")
    return F.when(score.isNull() | F.isnan(score), "not_computed").otherwise(named)
