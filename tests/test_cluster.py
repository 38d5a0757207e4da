"""Trees and maps from pairs against those from a whole matrix."""

import math

import numpy as np
import pytest

from spectrafold.operators import cluster as C


def pairs_of(spark, d, names=None):
    names = names or [f"s{i:03d}" for i in range(len(d))]
    return spark.createDataFrame([(names[i], names[j], float(d[i, j])) for i in range(len(d)) for j in range(i + 1, len(d))], "sample_i string, sample_j string, d double").repartition(3)


def distances(points):
    return np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))


@pytest.mark.parametrize("n,seed", [(2, 0), (3, 1), (12, 2), (45, 3)])
def test_tree(spark, n, seed):
    rng = np.random.default_rng(seed)
    d = distances(rng.standard_normal((n, 4)))
    names, merges = C.linkage(pairs_of(spark, d))
    assert [(r["id"], r["sample"]) for r in names.orderBy("id").collect()] == [(i, f"s{i:03d}") for i in range(n)]
    got = [tuple(r) for r in merges.orderBy("step").select("a", "b", "height", "size").collect()]
    for (a, b, h, size), (x, y, g, many) in zip(got, C.average_linkage(d), strict=True):
        assert {a, b} == {x, y} and size == many and math.isclose(h, g, rel_tol=1e-12)
    assert sorted(C.leaf_order(got, n)) == list(range(n))


def test_a_chain_is_merged_in_many_rounds(spark):
    d = distances(np.array([[1.35**i] for i in range(14)]))
    got = [tuple(r) for r in C.linkage(pairs_of(spark, d))[1].orderBy("step").select("a", "b", "size").collect()]
    assert got == [tuple(sorted(m[:2])) + (m[3],) for m in C.average_linkage(d)]


def test_equal_distances(spark):
    d = np.ones((6, 6)) - np.eye(6)
    got = C.linkage(pairs_of(spark, d))[1].orderBy("step").collect()
    assert [r["height"] for r in got] == [1.0] * 5 and got[-1]["size"] == 6
    assert sorted(x for r in got for x in (r["a"], r["b"])) == list(range(10))


def test_a_missing_pair_is_an_error(spark):
    with pytest.raises(ValueError, match="each pair"):
        C.linkage(pairs_of(spark, distances(np.arange(5.0)[:, None])).where("sample_j != 's004' or sample_i != 's001'"))


def test_map(spark):
    flat = np.random.default_rng(5).standard_normal((20, 2))
    points, stress = C.scaled(pairs_of(spark, distances(flat)))
    x = np.array([[r["x0"], r["x1"]] for r in points.orderBy("sample").collect()])
    assert stress < 1e-8 and np.allclose(distances(x), distances(flat), atol=1e-4)
    d = distances(np.random.default_rng(6).standard_normal((15, 5)))
    points, stress = C.scaled(pairs_of(spark, d))
    x = np.array([[r["x0"], r["x1"]] for r in points.orderBy("sample").collect()])
    own = ((distances(x) - d) ** 2).sum() / 2
    assert math.isclose(own, stress, rel_tol=0.02) and stress <= 1.1 * min(C.scaling(d, seed=s)[1] for s in range(5))
