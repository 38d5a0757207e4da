"""Checks of counts and probabilities, and tables whose rows are replaced by key."""

import pytest
from pyspark.sql import functions as F

from spectrafold.operators import checks
from spectrafold.operators import distance as D
from spectrafold.plans import sinks

COUNTS = "sample string, feature string, c long"


@pytest.mark.parametrize(
    "rows,said",
    [
        ([("a", "x", 1), ("b", "x", 0)], "not above 0"),
        ([("a", "x", 1), ("b", None, 2)], "nulls"),
        ([(None, "x", 1), ("b", "x", 2)], "nulls"),
        ([("a", "x", None), ("b", "x", 2)], "nulls"),
        ([("a", "x", 1), ("a", "x", 2), ("b", "x", 2)], "twice"),
        ([("a", "x", 1)], "among them b"),
        ([], "among them a, b"),
    ],
)
def test_unfit_counts(spark, rows, said):
    samples = spark.createDataFrame([("a",), ("b",)], "sample string")
    with pytest.raises(ValueError, match=said):
        checks.checked(spark.createDataFrame(rows, COUNTS), samples)


def test_fit_counts(spark):
    counts = spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("b", "y", 1)], COUNTS)
    assert checks.checked(counts, counts) is counts and checks.checked(counts.limit(0)).count() == 0


def test_probabilities_are_checked_while_they_are_used(spark):
    low = spark.createDataFrame([("a", "x", -3), ("a", "y", 5), ("b", "x", 2), ("b", "y", 2)], COUNTS)
    with pytest.raises(Exception, match="global probability is not above 0"):
        D.weights(low, "inverse", 0.5).collect()
    with pytest.raises(Exception, match="sample's probability is not above 0"):
        D.kl_directed(low, 0.1).collect()


def test_rows_are_replaced_by_key(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "k int, a string, v double")
    got = lambda: sorted((tuple(r) for r in sinks.read_upserted(spark, path).select("k", "a", "v").collect()), key=str)
    first = rows(*((i, "x", float(i)) for i in range(40)), (1, None, 0.5))
    for _ in range(2):
        sinks.upsert(first, path, ["k", "a"])
        assert got() == sorted([(i, "x", float(i)) for i in range(40)] + [(1, None, 0.5)], key=str)
    sinks.upsert(rows((3, "x", -1.0), (1, None, -2.0), (99, "x", 9.0)), path, ["k", "a"])
    wanted = sorted([(i, "x", float(i) if i != 3 else -1.0) for i in range(40)] + [(1, None, -2.0), (99, "x", 9.0)], key=str)
    assert got() == wanted
    broken = rows((5, "x", 0.0), (6, "x", 0.0)).withColumn("v", F.when(F.col("k") == 6, F.raise_error(F.lit("lost")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        sinks.upsert(broken, path, ["k", "a"])
    assert got() == wanted
