"""Whole runs: from counts to pairs, scores and result rows, for one configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..operators import counts as A
from ..operators import distance as D
from ..operators import metrics as M

#: Fixed value: the label of a sample that has none.
UNKNOWN = "unknown"


def pairs(counts: DataFrame, method: str, config: Config, lengths: DataFrame | None = None) -> DataFrame:
    """(sample_i, sample_j, d) for i < j by one of the methods; counts may be compressed."""
    if method == "kl":
        weight = D.weights(counts, config.weight, config.beta, config.cap_weight, config.scale_weight)
        return D.kl_symmetric(counts, config.alpha, weight, config.clip)
    if method == "tfidf_kl":
        return D.symmetric(D.tfidf_directed(counts, config.strict_idf, config.epsilon), config.clip)
    if method == "jsd":
        return D.root(D.jsd(counts, config.log_base, config.alpha))
    if method == "kwip":
        return D.kwip_distance(D.kwip_kernel(counts))
    weight = None
    if method in ("cosine_idf", "cosine_idf_length"):
        weight = D.idf_weights(counts, config.idf_min_df, config.idf_max_df_fraction, config.idf_power)
    if method in ("cosine", "cosine_length", "cosine_idf", "cosine_idf_length"):
        similar = D.cosine_similarity(counts, weight)
        return D.to_distance(D.length_weighted(similar, lengths) if method.endswith("_length") else similar)
    raise ValueError(f"unknown method {method}")


def scored(distances: DataFrame, labels: DataFrame, config: Config) -> DataFrame:
    """(sample, label, silhouette, status); with 'exclude', samples of excluded classes have NaN; all have if a label is unknown."""
    kept = M.silhouettes(distances, labels, config.singletons, UNKNOWN)
    if config.singletons == "exclude":
        kept = labels.join(kept.select("sample", "silhouette"), "sample", "left").fillna(float("nan"), ["silhouette"])
    return M.statuses(kept, config.clear_above, config.middle)


def overall_row(counts: DataFrame, distances: DataFrame, labels: DataFrame, method: str, config: Config) -> DataFrame:
    """One row: the configuration, the size of the problem, the overall silhouette and that of named samples alone, and how many distances are negative.

    Named samples are those whose label is not unknown, in classes of two or more; with an unknown one, the overall is NaN.
    """
    kept = M.silhouettes(distances, labels, config.singletons, UNKNOWN)
    named = M.overall(M.silhouettes(distances, M.without_class(labels, UNKNOWN), config.singletons)).withColumnRenamed("silhouette", "named_silhouette")
    size = A.overall(counts).select("vocabulary", "zero_percentage")
    score = M.overall(kept)
    row = size.crossJoin(F.broadcast(score)).crossJoin(F.broadcast(named)).crossJoin(F.broadcast(D.before_cleanup(distances).select("negative")))
    return row.select(F.lit(method).alias("method"), F.lit(config.k).alias("k"), F.lit(config.alpha).alias("alpha"), F.lit(config.beta).cast("double").alias("beta"), "vocabulary", "zero_percentage", "silhouette", "named_silhouette", "negative")
