"""Grids of parameters, and the choice of the best."""

from __future__ import annotations

import itertools
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..operators import counts as A
from ..operators import distance as D
from ..operators import metrics as M
from .shared import written


def grid(config: Config, **values: Iterable) -> list[Config]:
    """A configuration for each combination, the last named parameter changing fastest."""
    return [config.but(**dict(zip(values, combination, strict=True))) for combination in itertools.product(*values.values())]


def kl_sweep(counts: DataFrame, labels: DataFrame, configs: list[Config]) -> DataFrame:
    """(k, alpha, beta, silhouette), a row for each configuration, from one table of counts.

    Configurations that differ in k, alpha and beta only are one plan. beta null stands for equal weights. Of equal labels,
    or without pairs, the score is NaN.
    """
    return _swept(counts.withColumn("k", F.lit(0)), labels, [(0, config) for config in configs])


def kl_sweep_by_k(counts: DataFrame, labels: DataFrame, configs: list[Config]) -> DataFrame:
    """(k, alpha, beta, silhouette) like kl_sweep, from counts(k, sample, feature, c) of all k together, which are read once."""
    return _swept(counts, labels, [(config.k, config) for config in configs])


def _swept(counts: DataFrame, labels: DataFrame, configs: list[tuple[int, Config]]) -> DataFrame:
    """(k, alpha, beta, silhouette) of each configuration, from the counts of the k that stands before it.

    The distinct vectors of counts are written once, so that no branch of the plan makes them again.
    """
    kinds: dict[tuple, list[tuple[int, Config]]] = {}
    for at, config in configs:
        if config.alpha <= 0:
            raise ValueError("alpha must be positive: absent features have no logarithm")
        kinds.setdefault((config.weight, config.cap_weight, config.scale_weight, config.clip, config.singletons), []).append((at, config))
    vectors = written(A.profiles(counts.where(F.col("k").isin([at for at, _ in configs])), ("k",)), "profiles")
    out = None
    for (weight, cap, scale, clip, singletons), same in kinds.items():
        pairs = D.kl_grid_by_k(vectors, [(g, at, c.alpha, c.beta) for g, (at, c) in enumerate(same)], weight, cap, scale, clip)
        scores = M.grid_scores(pairs, labels, "g", singletons)
        grid = F.array(*(F.struct(F.lit(g).alias("g"), F.lit(c.k).alias("k"), F.lit(float(c.alpha)).alias("alpha"), F.lit(c.beta).cast("double").alias("beta")) for g, (_, c) in enumerate(same)))
        rows = counts.sparkSession.range(1).select(F.inline(grid)).join(scores, "g", "left").fillna(float("nan"), ["silhouette"]).select("k", "alpha", "beta", "silhouette")
        out = rows if out is None else out.unionByName(rows)
    return out


def best(results: DataFrame, score: str = "silhouette", order: tuple[str, ...] = ("k", "alpha", "beta")) -> DataFrame:
    """The row with the largest score; of equal ones the first in the given order. NaN and null never win."""
    fine = results.where(F.col(score).isNotNull() & ~F.isnan(score))
    return fine.orderBy(F.col(score).desc(), *(F.col(c).asc_nulls_first() for c in order if c in results.columns)).limit(1)


def best_per(results: DataFrame, group: str = "k", score: str = "silhouette", order: tuple[str, ...] = ("alpha", "beta")) -> DataFrame:
    """The best row of each group."""
    fine = results.where(F.col(score).isNotNull() & ~F.isnan(score))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), *(F.col(c).asc_nulls_first() for c in order if c in results.columns)))
    return fine.withColumn("_n", rank).where("_n = 1").drop("_n")


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(order).desc()))
    return rows.withColumn("_n", rank).where("_n = 1").drop("_n")


__all__ = ["best", "best_per", "grid", "kl_sweep", "kl_sweep_by_k", "latest"]
