"""Sums of pairs of samples, cell by cell, against dense products."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spectrafold.operators import blocks as B
from spectrafold.operators import distance as D

from . import fixtures as X


def dense(spark, n, features, share, seed, one_has_all=True):
    rng = np.random.default_rng(seed)
    c = rng.integers(1, 9, (n, features)) * (rng.random((n, features)) < share)
    if one_has_all:
        c[:, 0] = rng.integers(1, 9, n)  # a feature that all samples have
    names = [f"{'é' if i % 7 == 0 else 's'}{i}" for i in range(n)]
    rows = [(names[i], f"f{j}", int(c[i, j])) for i, j in zip(*np.nonzero(c), strict=True)]
    order = sorted(range(n), key=lambda i: names[i].encode())
    return [names[i] for i in order], c[order].astype(float), spark.createDataFrame(rows, "sample string, feature string, c long").repartition(5)


def table(pairs, names, value):
    at, out = {n: i for i, n in enumerate(names)}, np.zeros((len(names),) * 2)
    for r in pairs.collect():
        assert at[r["i"]] < at[r["j"]] and not out[at[r["i"]], at[r["j"]]]
        out[at[r["i"]], at[r["j"]]] = r[value]
    return out


@pytest.mark.parametrize("block,entries", [(1024, 200_000), (7, 90)])
def test_products(spark, monkeypatch, block, entries):
    monkeypatch.setattr(B, "BLOCK", block)
    monkeypatch.setattr(B, "ENTRIES", entries)
    names, c, counts = dense(spark, 40, 30, 0.3, 1)
    values = counts.select("sample", "feature", F.col("c").cast("double").alias("x"), (F.col("c") * F.col("c")).cast("double").alias("y"))
    got = B.product_sums(values, counts, "x", "y").persist()
    for term, full in (("ij", c @ (c**2).T), ("ji", (c**2) @ c.T)):
        assert np.allclose(table(got, names, term), np.triu(full, 1))
    factors = lambda t: {3: (t["x"], t["ws"][:, 1]), 5: (t["x"] * 2, t["x"])}
    grid = B.grid_sums(values.withColumn("ws", F.array(F.lit(1.0), F.col("y"))), counts, ["x", "ws"], factors).persist()
    assert np.allclose(table(grid.where("g = 3"), names, "ij"), np.triu(c @ (c**2).T, 1))
    assert np.allclose(table(grid.where("g = 5"), names, "ji"), np.triu(2 * c @ c.T, 1))
    least = lambda i, j: {"low": np.minimum(i["x"], j["x"]), "first": i["x"]}
    other = B.pair_sums(values, counts, ["x"], least, ["low", "first"]).persist()
    assert np.allclose(table(other, names, "low"), np.triu(np.minimum(c[:, None], c).sum(2), 1))
    assert np.allclose(table(other, names, "first"), np.triu((c[:, None] * (c > 0)).sum(2), 1))


def test_one_feature_of_all_samples_is_split(spark, monkeypatch):
    """Each pair of blocks is a cell of its own, so that no task sees all entries of the feature."""
    monkeypatch.setattr(B, "BLOCK", 50)
    rows = [(f"s{i}", "f", 1.0) for i in range(1000)]
    values = spark.createDataFrame(rows, "sample string, feature string, x double")
    cells = B._cells(values, values, ["x"], ()).groupBy("cell").count().collect()
    assert len(cells) == 20 * 21 // 2 and max(r["count"] for r in cells) < 180
    got = B.product_sums(values, values, "x", "x")
    assert got.agg(F.count("*"), F.sum("ij")).first() == (1000 * 999 // 2, 1000 * 999 / 2)


def test_dense_and_listed_features_agree():
    """Features of many samples are multiplied as a matrix, those of few pair by pair."""
    rng = np.random.default_rng(4)
    features = np.repeat(np.arange(40), rng.integers(1, 200, 40))
    places = np.concatenate([rng.permutation(200)[:n] for n in np.bincount(features)])
    left, right = rng.random((2, len(features)))
    cell = B.Cell()
    cell.places(pa.array([f"n{i}" for i in range(200)]), np.zeros(200, int))
    cell.multiply("s", features, places, left, right)
    one, two = np.zeros((2, 40, 200))
    one[features, places], two[features, places] = left, right
    full = one.T @ two
    np.fill_diagonal(full, 0)
    own = cell.room("s")
    np.fill_diagonal(own, 0)
    assert (np.bincount(features) >= B.DENSE).any() and (np.bincount(features) < B.DENSE).any() and np.allclose(own, full)


@pytest.mark.parametrize("alpha", [1e-6, 0.5, 20.0])
def test_smoothed_jsd_in_closed_form(spark, alpha):
    names, c, counts = dense(spark, 9, 40, 0.4, 2, False)
    got = {(r["sample_i"], r["sample_j"]): r["d"] for r in D.jsd(counts, alpha=alpha).collect()}
    full = X.jensen_shannon(X.smoothed(c, alpha))
    assert len(got) == 36 and all(math.isclose(v, full[names.index(i), names.index(j)], rel_tol=1e-9, abs_tol=1e-12) for (i, j), v in got.items())


def test_grid_is_the_same_as_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(D, "GRID", 2)
    _, _, counts = dense(spark, 6, 12, 0.5, 3)
    grid = [(0, 0.1, None), (1, 1.0, 0.5), (2, 0.1, 2.0), (3, 3.0, 0.5), (4, 1.0, None)]
    for kind, cap, scale in (("one", None, False), ("inverse", 3.0, False), ("neglog", None, True)):
        got = {(r["g"], r["sample_i"], r["sample_j"]): r["d"] for r in D.kl_grid(counts, [(g, a, b if kind == "one" else b or 1.0) for g, a, b in grid], kind, cap, scale).collect()}
        for g, alpha, beta in grid:
            for r in D.kl_symmetric(counts, alpha, D.weights(counts, kind, beta or 1.0, cap, scale)).collect():
                assert math.isclose(got[g, r["sample_i"], r["sample_j"]], r["d"], rel_tol=1e-9, abs_tol=1e-13)
        assert len(got) == 5 * 15
