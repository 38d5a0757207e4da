"""Hard negatives against all pairs in whole numbers."""

import math
import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from spectrafold.llm import negatives as N  # noqa: E402

COLUMNS = "vec_id long, embedding array<double>, label int, row string, cell int, size string, Score int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, lab, "r", 1, "s", 2) for i, v, lab in rows], COLUMNS).repartition(3)


def plain(rows, divisor=100, positives=5, negatives=10, low=30, high=90):
    fine = []
    for i, v, lab in rows:
        if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v):
            fine.append((i, [math.floor(256 * x) for x in v], lab, len(fine)))
    clip = lambda x: max(-(2**63 - 1), min(2**63 - 1, x))
    out = []
    for i, q, lab, row in fine:
        if i % divisor:
            continue
        scored = sorted((-clip(sum(a * b for a, b in zip(q, v, strict=True))), j, n, other) for j, v, other, n in fine if n != row and len(v) == len(q))
        for s, p, _, _ in [x for x in scored if x[3] == lab][:positives]:
            fits = [(-t, j) for t, j, _, other in scored if other != lab and -low * s <= -100 * t <= -high * s][:negatives]
            out += [(i, p, n, j, -s, t) for n, (t, j) in enumerate(fits, 1)]
    return sorted(out)


def got(spark, rows, **options):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[c] for c in names) for r in N.mine(frame(spark, rows), **options).collect())


@pytest.mark.parametrize("spread", [0.05, 0.6, 3.0])
def test_all_pairs(spark, spread):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((6, 15))
    own = rng.integers(0, 6, 900)
    x = centers[own] + spread * rng.standard_normal((900, 15))
    rows = [(i, v.tolist(), int(lab)) for i, v, lab in zip(range(900), x, (own + (rng.random(900) < 0.3)) % 5, strict=True)]
    assert got(spark, rows) == plain(rows)


def test_many_cells(spark, monkeypatch):
    for name, value in {"ANCHORS": 3, "STRIPE": 40, "LEAST": 10, "CHUNK": 7, "FIT": 50, "FEW": 0}.items():
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((400, 6)) + 0.7
    rows = [(i, v.tolist(), i % 3 if i % 4 else 0) for i, v in enumerate(x)]
    assert got(spark, rows, divisor=10) == plain(rows, 10)


def test_ties_copies_and_odd_rows(spark):
    r = random.Random(2)
    same = [0.5, 0.25, 0.125]
    rows = [(i, same, i % 2) for i in range(0, 60)] + [(i, [x * 0.8 for x in same], i % 2) for i in range(60, 130)]
    rows += [(200, None, 1), (200, same, None), (300, [0.1, None, 0.2], 0), (300, [math.nan, 1.0, 1.0], 0), (400, [math.inf, 1.0, 1.0], 0), (400, [1e308, 1.0, 1.0], 0), (None, same, 1)]
    rows += [(500, [0.0, 0.0, 0.0], 0), (600, [], 0), (700, [], 1), (701, [], 0), (800, [1.0, 2.0], 0), (801, [1.0, 2.5], 0), (802, [1.0, 1.0], 1), (803, [-1.0, -1.0], 1), (900, [-1.0, -1.0, -1.0], 3)]
    r.shuffle(rows)
    assert got(spark, rows) == plain(rows)


def test_scores_beyond_doubles_and_longs(spark):
    rows = [(100, [1e6, 1e6 + 1 / 256], 0), (1, [1e6, 1e6], 0), (2, [6e5, 6e5 + 3 / 256], 1), (3, [6e5 + 3 / 256, 6e5], 1), (200, [1e12, 3.0], 2), (4, [1e12, 1.0], 2), (5, [1e200, 1e200], 3), (6, [1.0, 1.0], 4)]
    assert got(spark, rows) == plain(rows)


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(100, [1.0, 0.0], 0), (100, [1.0, 0.0], 0), (1, [0.5, 0.0], 1), (1, [0.5, 0.0], 1)]
    assert got(spark, rows) == sorted([(100, 100, n, 1, 65536, 32768) for n in (1, 2)] * 2)


def test_nothing(spark):
    assert got(spark, []) == [] and got(spark, [(100, None, 1)]) == [] and got(spark, [(100, [1.0], 1)]) == []


def test_bounds_hold():
    """Looked-up scores differ from exact ones by no more than the residuals' bound."""
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.standard_normal((500, 13)))
    book = N.Codebook({13: x[:300]})
    codes, rest = book.coded(x)
    products, norms = book.tables(x[:40])
    near = sum(table[:, codes[:, m]] for m, table in enumerate(products))
    bound = norms @ rest.T.astype(float)
    assert (np.abs(near - x[:40] @ x.T) <= bound + 1e-6).all()
    assert (bound / np.sqrt((x[:40] ** 2).sum(1))[:, None] / np.sqrt((x**2).sum(1))).mean() < 0.2
    assert np.array_equal(book.of(7), np.zeros((4, 1, 2)))
