"""Aggregates of counts(sample, feature, c), and its compression into profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import quantiles


def many(counts: DataFrame) -> Column:
    """How many features a row stands for: the column `many` of compressed counts, else 1."""
    return F.col("many") if "many" in counts.columns else F.lit(1).cast("long")


def sample_stats(counts: DataFrame) -> DataFrame:
    """(sample, total, kinds, squares) of each sample."""
    m, c = many(counts), F.col("c")
    return counts.groupBy("sample").agg(F.sum(c * m).alias("total"), F.sum(m).alias("kinds"), F.sum(c.cast("double") * c * m).alias("squares"))


def feature_stats(counts: DataFrame) -> DataFrame:
    """(feature, c, df, many): global count and number of samples of each feature."""
    return counts.groupBy("feature").agg(F.sum("c").alias("c"), F.count("*").alias("df"), F.first(many(counts)).alias("many"))


def presence(counts: DataFrame) -> DataFrame:
    """(feature, df, f, many): the share of samples that have each feature."""
    every = counts.agg(F.count_distinct("sample").alias("n"))
    return feature_stats(counts).crossJoin(F.broadcast(every)).select("feature", "df", (F.col("df") / F.col("n")).alias("f"), "many")


def overall(counts: DataFrame) -> DataFrame:
    """One row: samples, vocabulary, total, stored entries, and the percentage of the sample-by-feature table that is 0."""
    per, m = feature_stats(counts), F.col("many")
    features = per.agg(F.sum(m).alias("vocabulary"), F.sum(F.col("c") * m).alias("total"), F.sum(F.col("df") * m).alias("entries"))
    every = features.crossJoin(counts.agg(F.count_distinct("sample").alias("samples")))
    cells = F.col("samples") * F.col("vocabulary")
    return every.select("samples", "vocabulary", "total", "entries", (100.0 * (cells - F.col("entries")) / cells).alias("zero_percentage"))


def describe(rows: DataFrame, value: str) -> DataFrame:
    """One row: least, largest, mean and median value, and how many are 0 and not 0. The median is exact, and found by counting in bins."""
    v = F.col(value)
    (median,) = quantiles(rows, value, [0.5])
    return rows.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.lit(median).cast("double").alias("median"), F.count_if(v == 0).alias("zero"), F.count_if(v != 0).alias("nonzero"))


def histogram(rows: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """(bin, low, high, rows) of equal bins from the least to the largest value, which belongs to the last."""
    v = F.col(value)
    ends = rows.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.lit(bins - 1), F.floor((v - F.col("lo")) / F.nullif(width, F.lit(0.0)))))
    counted = rows.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin"), "lo", "hi").agg(F.count("*").alias("rows"))
    return counted.select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "rows")


def class_counts(labelled: DataFrame, label: str = "label") -> DataFrame:
    return labelled.groupBy(label).agg(F.count("*").alias("samples"))


def label_codes(labelled: DataFrame, label: str = "label", by: str = "value", position: str | None = None) -> DataFrame:
    """labelled with `code`: labels numbered from 0 by value, or by the first position at which each appears."""
    if by == "value":
        order = labelled.select(label).distinct().withColumn("_at", F.col(label))
    else:
        order = labelled.groupBy(label).agg(F.min(position or "sample").alias("_at"))
    codes = order.withColumn("code", F.row_number().over(Window.orderBy("_at")) - 1).drop("_at")
    return labelled.join(codes, label)


def top_vocabulary(counts: DataFrame, per_sample: int, shared: int) -> DataFrame:
    """counts of the `shared` features with the largest sums over each sample's `per_sample` most frequent ones.

    Ties go to the smaller feature. All counts of a chosen feature stay; totals taken from the result are over these alone.
    """
    first = Window.partitionBy("sample").orderBy(F.col("c").desc(), F.col("feature").asc())
    best = counts.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_sample)
    chosen = best.groupBy("feature").agg(F.sum("c").alias("_sum")).orderBy(F.col("_sum").desc(), F.col("feature").asc()).limit(shared)
    return counts.join(chosen.select("feature"), "feature", "left_semi")


def by_document_frequency(counts: DataFrame, least: int = 1, largest_share: float = 1.0) -> DataFrame:
    """(feature, df) of the features in at least `least` samples and at most max(1, floor(largest_share * samples))."""
    every = counts.agg(F.count_distinct("sample").alias("n"))
    most = F.greatest(F.lit(1), F.floor(F.lit(largest_share) * F.col("n")))
    return feature_stats(counts).crossJoin(F.broadcast(every)).where((F.col("df") >= least) & (F.col("df") <= most)).select("feature", "df", "n")


def profiles(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, profile, many): the distinct vectors of counts over samples, and how many features have each.

    A distance depends on a feature by its vector alone, so all distances and all parameters of a sweep need only these. A
    vector lists the samples that have the feature, in order: one entry a sample at most. Counts may be compressed already.
    """
    vector = F.array_sort(F.collect_list(F.struct("sample", "c")))
    vectors = counts.groupBy(*by, "feature").agg(vector.alias("profile"), F.first(many(counts)).alias("many"))
    return vectors.groupBy(*by, "profile").agg(F.sum("many").alias("many"))


def compressed(counts: DataFrame) -> DataFrame:
    """counts (sample, feature, c, many): one feature for all that have the same vector of counts."""
    return from_profiles(profiles(counts))


def compressed_by(counts: DataFrame, by: str) -> DataFrame:
    """(by, sample, feature, c, many): the same for each value of a column, such as k, in one plan."""
    return from_profiles(profiles(counts, (by,)), (by,))


def from_profiles(vectors: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """counts (*by, sample, feature, c, many) with a feature for each distinct vector."""
    numbered = vectors.withColumn("feature", F.xxhash64("profile").cast("string"))
    return numbered.select(*by, "feature", "many", F.explode("profile").alias("p")).select(*by, "p.sample", "feature", "p.c", "many")
