"""How well distances separate labelled samples: (sample_i, sample_j, d) for i < j with labels (sample, label)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formulas


def both_ways(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Each pair in both directions."""
    i, j = F.col("sample_i"), F.col("sample_j")
    two = F.explode(F.array(F.struct(i, j), F.struct(j.alias("sample_i"), i.alias("sample_j"))))
    return pairs.select(*by, two.alias("_p"), "d").select(*by, "_p.sample_i", "_p.sample_j", "d")


def labelled_pairs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """pairs with label_i and label_j."""
    i = labels.select(F.col("sample").alias("sample_i"), F.col("label").alias("label_i"))
    j = labels.select(F.col("sample").alias("sample_j"), F.col("label").alias("label_j"))
    return pairs.join(i, "sample_i").join(j, "sample_j")


def without_singletons(labels: DataFrame) -> DataFrame:
    """Labels of the classes with two samples or more."""
    many = labels.groupBy("label").count().where("count > 1").select("label")
    return labels.join(many, "label", "left_semi").select("sample", "label")


def without_class(labels: DataFrame, label) -> DataFrame:
    """Labels but for one class, and of the rest the classes with two samples or more."""
    return without_singletons(labels.where(F.col("label") != label))


def fit_for_silhouette(labels: DataFrame, unknown: str | None = None) -> bool:
    """Whether there are 2 classes or more, fewer than samples, and none is the unknown one."""
    row = labels.agg(F.count("*").alias("n"), F.count_distinct("label").alias("k"), F.count_if(F.col("label").cast("string") == F.lit(unknown or "")).alias("u")).first()
    return 2 <= row["k"] < row["n"] and (unknown is None or row["u"] == 0)


def silhouettes(pairs: DataFrame, labels: DataFrame, singletons: str = "zero", unknown: str | None = None) -> DataFrame:
    """(sample, label, silhouette): (b - a) / max(a, b).

    a is the mean distance to the sample's own class, b the least mean distance to another. A class of one scores 0, or is
    left out before anything is computed ('exclude'); 0 / 0 is 0. With fewer than 2 classes, as many as samples, or a sample
    of the unknown class, every score is NaN.
    """
    used = without_singletons(labels) if singletons == "exclude" else labels
    means = labelled_pairs(both_ways(pairs), used).groupBy("sample_i", "label_i", "label_j").agg(F.avg("d").alias("m"))
    return scores(means, used, labels, unknown)


def scores(means: DataFrame, used: DataFrame, labels: DataFrame, unknown: str | None = None) -> DataFrame:
    """silhouettes() from mean distances (sample_i, label_i, label_j, m) of the labels in use, and from all labels."""
    missing = F.count_if(F.col("label").cast("string") == F.lit(unknown)) if unknown is not None else F.lit(0)
    blind = labels.agg(missing.alias("_u"))
    every = used.agg(F.count("*").alias("_n"), F.count_distinct("label").alias("_k"))
    same = F.col("label_i") == F.col("label_j")
    own = means.groupBy(F.col("sample_i").alias("sample")).agg(F.max(F.when(same, F.col("m"))).alias("a"), F.min(F.when(~same, F.col("m"))).alias("b"))
    out = used.join(own, "sample", "left").crossJoin(F.broadcast(every)).crossJoin(F.broadcast(blind))
    s = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
    return out.select("sample", "label", F.when((F.col("_k") < 2) | (F.col("_k") >= F.col("_n")) | (F.col("_u") > 0), F.lit(float("nan"))).otherwise(s).alias("silhouette"))


def grid_scores(pairs: DataFrame, labels: DataFrame, by: str, singletons: str = "zero") -> DataFrame:
    """(by, silhouette): the mean of silhouettes() of the pairs (by, sample_i, sample_j, d) of each `by`, in one plan."""
    used = without_singletons(labels) if singletons == "exclude" else labels
    every = used.agg(F.count("*").alias("_n"), F.count_distinct("label").alias("_k"))
    means = labelled_pairs(both_ways(pairs, (by,)), used).groupBy(by, "sample_i", "label_i", "label_j").agg(F.avg("d").alias("m"))
    same = F.col("label_i") == F.col("label_j")
    own = means.groupBy(by, "sample_i").agg(F.max(F.when(same, F.col("m"))).alias("a"), F.min(F.when(~same, F.col("m"))).alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).otherwise(F.coalesce((F.col("b") - F.col("a")) / F.nullif(F.greatest("a", "b"), F.lit(0.0)), F.lit(0.0)))
    # A sample without pairs scores 0, so it counts in the mean alone.
    mean = own.groupBy(by).agg(F.sum(s).alias("_s")).crossJoin(F.broadcast(every))
    fine = (F.col("_k") >= 2) & (F.col("_k") < F.col("_n"))
    return mean.select(by, F.when(fine, F.col("_s") / F.col("_n")).otherwise(F.lit(float("nan"))).alias("silhouette"))


def overall(scores: DataFrame) -> DataFrame:
    """One row: the mean silhouette."""
    return scores.agg(F.avg("silhouette").alias("silhouette"))


def by_class(scores: DataFrame) -> DataFrame:
    return scores.groupBy("label").agg(F.avg("silhouette").alias("silhouette"), F.count("*").alias("samples"))


def statuses(scores: DataFrame, clear_above: float = 0.10, middle: str = "weak/ambiguous") -> DataFrame:
    return scores.withColumn("status", formulas.status(F.col("silhouette"), clear_above, middle))


def within_between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: mean distance within classes, between them, and the first over the second."""
    named = labelled_pairs(pairs, labels)
    same = F.col("label_i") == F.col("label_j")
    row = named.agg(F.avg(F.when(same, F.col("d"))).alias("within"), F.avg(F.when(~same, F.col("d"))).alias("between"))
    return row.withColumn("ratio", F.col("within") / F.nullif("between", F.lit(0.0)))


def dunn(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: least distance between classes over the largest within one; NaN if that is 0."""
    named = labelled_pairs(pairs, labels)
    same = F.col("label_i") == F.col("label_j")
    row = named.agg(F.min(F.when(~same, F.col("d"))).alias("separation"), F.max(F.when(same, F.col("d"))).alias("diameter"))
    return dunn_of(row)


def dunn_of(row: DataFrame) -> DataFrame:
    """The row (separation, diameter) with `dunn`."""
    return row.withColumn("dunn", F.coalesce(F.col("separation") / F.nullif("diameter", F.lit(0.0)), F.lit(float("nan"))))


def neighbour_accuracy(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the share of samples whose nearest other sample has their label; ties go to the smaller name."""
    order = Window.partitionBy("sample_i").orderBy("d", "sample_j")
    near = labelled_pairs(both_ways(pairs), labels).withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return near.agg(F.avg((F.col("label_i") == F.col("label_j")).cast("double")).alias("accuracy"), F.count("*").alias("samples"))


def pseudo_mass(stats: DataFrame, vocabulary: DataFrame, alpha: float) -> DataFrame:
    """One row: what smoothing adds to a sample's counts, alpha x vocabulary, and its ratio to the mean total."""
    mean = stats.agg(F.avg("total").alias("mean_total"))
    row = vocabulary.select("vocabulary").crossJoin(F.broadcast(mean))
    return row.select((F.lit(float(alpha)) * F.col("vocabulary")).alias("pseudo_mass"), (F.lit(float(alpha)) * F.col("vocabulary") / F.col("mean_total")).alias("ratio"))
