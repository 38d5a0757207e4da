"""Checks of counts before anything heavy is computed from them, and of probabilities while it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positive(value: Column, said: str) -> Column:
    """The value, which must be above 0 and finite: a row with another one ends the query with an error."""
    return F.when((value > 0) & (value < float("inf")), value).otherwise(F.raise_error(F.lit(said)))


def checked(counts: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """The counts, after one query has shown that they are fit for distances.

    Raises ValueError if a sample, a feature or a count is null, a count is not above 0, a sample has a feature twice, or one
    of the samples (sample) has no counts at all.
    """
    null = F.col("sample").isNull() | F.col("feature").isNull() | F.col("c").isNull()
    per = counts.groupBy("sample", "feature").agg(F.count("*").alias("rows"), F.count_if(null).alias("null"), F.count_if(F.col("c") <= 0).alias("low"))
    found = per.agg(F.sum("null").alias("null"), F.sum("low").alias("low"), F.count_if(F.col("rows") > 1).alias("twice")).first()
    faults = [said for name, said in (("null", "nulls"), ("low", "counts that are not above 0"), ("twice", "features that a sample has twice")) if found[name]]
    if samples is not None:
        empty = [r["sample"] for r in samples.join(counts, "sample", "left_anti").select("sample").orderBy("sample").limit(5).collect()]
        faults += [f"samples without counts, among them {', '.join(map(str, empty))}"] if empty else []
    if faults:
        raise ValueError(f"the counts hold {'; '.join(faults)}")
    return counts
