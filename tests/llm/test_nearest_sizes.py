"""Nearest neighbours take one path at every size of the table; repeated rows are rows of their own."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from spectrafold.llm import ann  # noqa: E402


def frame(spark, names, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(names, x, strict=True)], "vec_id long, embedding array<double>").repartition(3)


@pytest.mark.parametrize("n", [30, 700, 2040, 2060])
def test_recall_at_every_size(spark, n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((12, 24))[rng.integers(0, 12, n)] + 0.5 * rng.standard_normal((n, 24))
    names = np.arange(n)
    got = {}
    for r in ann.search(frame(spark, names, x)).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    hit = total = 0
    for q, wanted in ann.all_pairs(x, names, np.arange(0, n, 20), 20):
        own = [v for _, v in sorted(got[q])]
        assert [r for r, _ in sorted(got[q])] == list(range(1, len(wanted) + 1))
        hit, total = hit + len(set(own) & set(wanted)), total + len(wanted)
    assert hit / total >= 0.9


@pytest.mark.parametrize("more", [0, 2100])
def test_repeated_rows(spark, more):
    rng = np.random.default_rng(4)
    v, w, u = np.ones(8), np.ones(8) * 0.9, np.ones(8) * 0.5
    names = [0, 0, 1, 1, 2, *range(101, 101 + more)]
    x = np.vstack([v, v, w, w, u, *(0.01 * rng.standard_normal((more, 8)))])
    names = np.array([i if i % 20 or not i else i + 100_001 for i in names])
    got = [(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.search(frame(spark, names, x), k=4).collect()]
    # Each of the two rows of query 0 finds the other one, both rows of 1, and 2.
    assert sorted(got) == sorted([(0, 1, 0, 8.0), (0, 2, 1, 7.2), (0, 3, 1, 7.2), (0, 4, 2, 4.0)] * 2)


def test_two_sets_of_centers(spark, monkeypatch):
    monkeypatch.setattr(ann, "FIT", 600)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((60, 16))[rng.integers(0, 60, 5000)] + 0.4 * rng.standard_normal((5000, 16))
    index = ann.Index(x[:600], 5000, 20)
    assert len(index.second) > 1 and index.lists >= 35
    got = {}
    for r in ann.search(frame(spark, np.arange(5000), x), divisor=100).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    wanted = ann.all_pairs(x, np.arange(5000), np.arange(0, 5000, 100), 20)
    assert sum(len(got[q] & set(best)) for q, best in wanted) / (20 * len(wanted)) >= 0.9
