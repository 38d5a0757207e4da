"""Places in an order, and exact quantiles, against sorting."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.functions import sequence as S
from spectrafold.operators import counts as A
from spectrafold.operators import order as O

rng = random.Random(3)


@pytest.mark.parametrize("size", [10, 70, 100_000])
def test_places(spark, size):
    rows = [(rng.choice("abcé") * rng.randrange(3), rng.randrange(40), i) for i in range(700)] + [(None, 1, 1000), ("a", None, 1001), ("x", 5, 5000)] + [("x", 5, i) for i in range(2000, 2300)]
    df = spark.createDataFrame(rows, "a string, b int, i int").repartition(6)
    got = {(r["a"], r["b"], r["i"]): r["place"] for r in O.ranked(df, [F.col("a"), F.col("b"), F.col("i")], size=size).collect()}
    want = sorted(rows, key=lambda r: ((r[0] is not None, (r[0] or "").encode()), (r[1] is not None, r[1] or 0), r[2]))
    assert got == {r: n for n, r in enumerate(want, 1)}
    ties = O.ranked(df.select("a"), [F.col("a")], size=size).collect()
    assert sorted(r["place"] for r in ties) == list(range(1, len(rows) + 1))
    assert [r["a"] for r in sorted(ties, key=lambda r: r["place"])] == [r[0] for r in want]
    assert O.ranked(df.limit(0), [F.col("a")], size=size).count() == 0


def test_no_window_over_all_rows(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("x"))
    ranked = O.ranked(df, [F.col("x")], size=500)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"windowspecdefinition\((\w+)", plan) and all(c == "_range" for c in re.findall(r"windowspecdefinition\(([a-z_]+)", plan))
    assert ranked.agg(F.max("place")).first()[0] == 5000


def test_natural_order(spark):
    names = ["s10", "s9", "s1b", "s1a20", "s1a3", "s01", "s1", "10", "9", "", "a1.2.3.4.5.10", "a1.2.3.4.5.9", "s" + "9" * 30, "s1" + "0" * 30]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r["n"] for r in O.ranked(df, [*S.natural_key(F.col("n")), F.col("n")], size=3).orderBy("place").collect()]
    assert got == ["", "9", "10", "a1.2.3.4.5.9", "a1.2.3.4.5.10", "s01", "s1", "s1a3", "s1a20", "s1b", "s9", "s10", "s" + "9" * 30, "s1" + "0" * 30]


@pytest.mark.parametrize("kind", ["even", "skewed", "tied", "huge", "one", "tiny", "signs"])
def test_quantiles(spark, kind, monkeypatch):
    monkeypatch.setattr(O, "BINS", 8)
    r = np.random.default_rng(1)
    x = {"even": r.random(501), "skewed": np.exp(12 * r.standard_normal(600)), "tied": r.integers(0, 3, 400) * 1.0, "huge": np.array([-1.7e308, 1.7e308, 0.0, 1.0, 2.0]), "one": np.array([4.0]), "tiny": np.nextafter(1, 2) ** r.integers(0, 4, 99), "signs": np.array([-1.0, 0.0, 1.0, -5e-324, 5e-324, 2.0])}[kind]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (math.nan,)], "x double").repartition(3)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = O.quantiles(df, "x", shares)
    for q, v in zip(shares, got, strict=True):
        at = q * (len(x) - 1)
        a, b = np.sort(x)[[math.floor(at), math.ceil(at)]]
        assert v == (a if a == b else a + (b - a) * (at - math.floor(at)))
    assert O.quantiles(df.limit(0), "x", [0.5]) == [None]
    assert A.describe(df.where("not isnan(x)"), "x").first()["median"] == got[2]


def test_no_row_carries_the_borders(spark):
    ranked = O.ranked(spark.range(3000).select((F.col("id") * 7 % 3001).alias("x")), [F.col("x")], size=100)
    assert "NestedLoop" not in ranked._jdf.queryExecution().executedPlan().toString()
