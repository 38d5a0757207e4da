import itertools
import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spectrafold.config import Config
from spectrafold.operators import cluster
from spectrafold.operators import counts as A
from spectrafold.operators import distance as D
from spectrafold.operators import metrics as M
from spectrafold.plans import runs, sinks, sweep

from . import fixtures as X

DATA = {
    "a": Counter({"x": 5, "y": 1, "z": 2, "p": 1}),
    "b": Counter({"x": 4, "y": 2, "q": 3}),
    "c": Counter({"z": 7, "q": 1, "r": 1, "y": 1}),
    "d": Counter({"x": 5, "y": 1, "z": 2, "p": 1}),
    "e": Counter({"s": 9}),
}


def frame(spark, data=None):
    rows = [(s, w, c) for s, own in (data or DATA).items() for w, c in own.items()]
    return spark.createDataFrame(rows, "sample string, feature string, c long")


def matrix(pairs, names, value="d"):
    out = np.zeros((len(names), len(names)))
    for r in pairs.collect():
        i, j = names.index(r["sample_i"]), names.index(r["sample_j"])
        out[i, j] = out[j, i] = r[value]
    return out


@pytest.fixture(scope="module", params=[False, True], ids=["plain", "compressed"])
def counts(spark, request):
    out = frame(spark)
    return (A.compressed(out) if request.param else out).persist()


def test_kl(counts):
    names, c = X.dense(DATA)
    for alpha in (0.001, 1.0):
        p = X.smoothed(c, alpha)
        assert np.allclose(matrix(D.kl_symmetric(counts, alpha), names), X.symmetric_kl(p), rtol=1e-10, atol=1e-12)
    rows = D.kl_directed(counts, 1.0).collect()
    p = X.smoothed(c, 1.0)
    assert len(rows) == 20
    for r in rows:
        a, b = p[names.index(r["sample_i"])], p[names.index(r["sample_j"])]
        assert math.isclose(r["d"], (a * np.log(a / b)).sum(), rel_tol=1e-9, abs_tol=1e-12)
    with pytest.raises(ValueError):
        D.kl_directed(counts, 0.0)


@pytest.mark.parametrize("kind", ["neglog", "inverse", "inverse_sqrt"])
@pytest.mark.parametrize("cap,scale", [(None, False), (2.5, False), (None, True)])
def test_weighted_kl(counts, kind, cap, scale):
    names, c = X.dense(DATA)
    g = (c.sum(0) + 0.5) / (c.sum() + 0.5 * c.shape[1])
    w = {"neglog": -np.log(g), "inverse": 1 / g, "inverse_sqrt": 1 / np.sqrt(g)}[kind]
    w = np.minimum(w, cap) if cap else w
    w = w / w.max() if scale else w
    got = D.kl_symmetric(counts, 0.1, D.weights(counts, kind, 0.5, cap, scale))
    assert np.allclose(matrix(got, names), X.symmetric_kl(X.smoothed(c, 0.1), w), rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("strict", [False, True])
def test_tfidf(spark, counts, strict):
    names, c = X.dense(DATA)
    df = (c > 0).sum(0)
    idf = np.log(len(names) / df) if strict else np.log((len(names) + 1) / (df + 1)) + 1
    s = c / c.sum(1, keepdims=True) * idf
    p = (s / s.sum(1, keepdims=True) + 1e-12) / (1 + 1e-12 * c.shape[1])
    got = D.symmetric(D.tfidf_directed(counts, strict), "none")
    assert np.allclose(matrix(got, names), X.symmetric_kl(p), rtol=1e-8, atol=1e-9)
    same = frame(spark, {"a": Counter({"x": 1}), "b": Counter({"x": 2})})
    with pytest.raises(Exception, match="sums to 0"):
        D.tfidf_directed(same, strict=True).collect()


def test_jsd(counts):
    names, c = X.dense(DATA)
    for base, alpha in ((2.0, 0.0), (10.0, 0.0), (2.0, 0.5)):
        p = X.smoothed(c, alpha)
        got = matrix(D.jsd(counts, base, alpha), names)
        assert np.allclose(got, X.jensen_shannon(p, base), atol=1e-12)
    assert math.isclose(matrix(D.jsd(counts), names)[0, 4], 1.0)
    assert np.allclose(matrix(D.root(D.jsd(counts)), names) ** 2, X.jensen_shannon(X.smoothed(c, 0.0)), atol=1e-12)


def test_cosine(spark, counts):
    names, c = X.dense(DATA)
    norm = np.linalg.norm(c, axis=1)
    s = c @ c.T / np.outer(norm, norm)
    assert np.allclose(matrix(D.to_distance(D.cosine_similarity(counts)), names), np.where(np.eye(5), 0, 1 - s), atol=1e-12)
    df, n = (c > 0).sum(0), len(names)
    w = np.where((df >= 2) & (df <= max(1, math.floor(0.7 * n))), (np.log((n + 1) / (df + 1)) + 1) ** 2.0, 0)
    x = c * w
    norm = np.linalg.norm(x, axis=1)
    s = np.where(np.outer(norm, norm) > 0, x @ x.T / np.maximum(np.outer(norm, norm), 1e-300), 0)
    got = D.cosine_similarity(counts, D.idf_weights(counts, 2, 0.7, 2.0))
    assert np.allclose(matrix(got, names, "s"), np.where(np.eye(5), 0, s), atol=1e-12)
    lengths = spark.createDataFrame([(m, 10 * (i + 1)) for i, m in enumerate(names)], "sample string, length long")
    got = matrix(D.length_weighted(D.cosine_similarity(counts), lengths), names, "s")
    assert math.isclose(got[0, 1], matrix(D.cosine_similarity(counts), names, "s")[0, 1] * (1 - 10 / 15))


def test_kwip(counts):
    names, c = X.dense(DATA)
    f = (c > 0).mean(0)
    h = np.array([0.0 if v in (0, 1) else -v * np.log2(v) - (1 - v) * np.log2(1 - v) for v in f])
    k = (c * h) @ c.T
    rows = {(r["sample_i"], r["sample_j"]): r["kernel"] for r in D.kwip_kernel(counts).collect()}
    assert len(rows) == 15
    for (a, b), v in rows.items():
        assert math.isclose(v, k[names.index(a), names.index(b)], rel_tol=1e-12, abs_tol=1e-12)
    d = np.diag(k)
    s = np.clip(k / np.sqrt(np.outer(d, d)), -1, 1)
    expected = np.where(np.eye(5), 0, np.sqrt(np.maximum(0, 2 - 2 * s)))
    assert np.allclose(matrix(D.kwip_distance(D.kwip_kernel(counts)), names), expected, atol=1e-7)


def test_aggregates(spark, counts):
    row = A.overall(counts).first()
    _, c = X.dense(DATA)
    assert (row["samples"], row["vocabulary"], row["total"], row["entries"]) == (5, c.shape[1], c.sum(), (c > 0).sum())
    assert math.isclose(row["zero_percentage"], 100 * (c == 0).mean())
    stats = {r["sample"]: tuple(r)[1:] for r in A.sample_stats(counts).collect()}
    assert stats["b"] == (9, 3, 29.0)
    plain = frame(spark)
    chosen = {r["feature"] for r in A.top_vocabulary(plain, 1, 2).select("feature").distinct().collect()}
    assert chosen == {"x", "s"}
    h = A.histogram(spark.createDataFrame([(float(v),) for v in (0, 1, 1, 2, 10)], "v double"), "v", 5).orderBy("bin").collect()
    assert [(r["bin"], r["rows"]) for r in h] == [(0, 3), (1, 1), (4, 1)]
    assert A.histogram(spark.createDataFrame([(3.0,), (3.0,)], "v double"), "v", 5).first()["rows"] == 2
    named = spark.createDataFrame([("s1", "b"), ("s2", "a"), ("s3", "b")], "sample string, label string")
    assert {(r["label"], r["code"]) for r in A.label_codes(named).collect()} == {("a", 0), ("b", 1)}
    assert {(r["label"], r["code"]) for r in A.label_codes(named, by="first", position="sample").collect()} == {("b", 0), ("a", 1)}


LABELS = ["u", "u", "v", "u", "w"]


def test_metrics(spark, counts):
    names, _ = X.dense(DATA)
    pairs = D.kl_symmetric(counts, 1.0).persist()
    d = matrix(pairs, names)
    labels = spark.createDataFrame(list(zip(names, LABELS, strict=True)), "sample string, label string")
    got = {r["sample"]: r["silhouette"] for r in M.silhouettes(pairs, labels).collect()}
    assert np.allclose([got[n] for n in names], X.silhouettes(d, LABELS))
    two = spark.createDataFrame(list(zip(names, ["u", "u", "v", "v", "w"], strict=True)), "sample string, label string")
    kept = M.silhouettes(pairs, two, "exclude").orderBy("sample").collect()
    assert [r["sample"] for r in kept] == ["a", "b", "c", "d"]
    assert np.allclose([r["silhouette"] for r in kept], X.silhouettes(d[:4, :4], ["u", "u", "v", "v"]))
    assert all(math.isnan(r["silhouette"]) for r in M.silhouettes(pairs, labels, "exclude").collect())
    assert not M.fit_for_silhouette(labels.withColumn("label", F.lit("x"))) and M.fit_for_silhouette(labels)
    inside = [d[i, j] for i, j in itertools.combinations(range(5), 2) if LABELS[i] == LABELS[j]]
    across = [d[i, j] for i, j in itertools.combinations(range(5), 2) if LABELS[i] != LABELS[j]]
    row = M.within_between(pairs, labels).first()
    assert np.allclose(list(row), [np.mean(inside), np.mean(across), np.mean(inside) / np.mean(across)])
    assert math.isclose(M.dunn(pairs, labels).first()["dunn"], min(across) / max(inside))
    assert math.isnan(M.dunn(pairs.withColumn("d", F.lit(0.0)), labels).first()["dunn"])
    near = [min((d[i, j], j) for j in range(5) if j != i)[1] for i in range(5)]
    assert math.isclose(M.neighbour_accuracy(pairs, labels).first()["accuracy"], np.mean([LABELS[i] == LABELS[j] for i, j in enumerate(near)]))
    said = {r["status"] for r in M.statuses(spark.createDataFrame([("a", "l", 0.2), ("b", "l", 0.0), ("c", "l", -0.1), ("d", "l", None), ("e", "l", float("nan"))], "sample string, label string, silhouette double")).collect()}
    assert said == {"clear", "weak/ambiguous", "possibly_misplaced", "not_computed"}


def test_sweep_and_choice(spark):
    counts = frame(spark)
    labels = spark.createDataFrame(list(zip(sorted(DATA), LABELS, strict=True)), "sample string, label string")
    rows = sweep.kl_sweep(counts, labels, sweep.grid(Config(beta=1.0, weight="inverse"), alpha=(0.1, 1.0), beta=(1.0, 2.0))).orderBy("alpha", "beta").collect()
    assert [(r["alpha"], r["beta"]) for r in rows] == [(0.1, 1.0), (0.1, 2.0), (1.0, 1.0), (1.0, 2.0)]
    names, c = X.dense(DATA)
    g = (c.sum(0) + 2.0) / (c.sum() + 2.0 * c.shape[1])
    assert math.isclose(rows[3]["silhouette"], np.mean(X.silhouettes(X.symmetric_kl(X.smoothed(c, 1.0), 1 / g), LABELS)), rel_tol=1e-9)
    table = spark.createDataFrame([(15, 1.0, 0.3), (15, 2.0, 0.3), (21, 1.0, 0.1), (21, 2.0, float("nan"))], "k int, alpha double, silhouette double")
    assert tuple(sweep.best(table).first()) == (15, 1.0, 0.3)
    assert {(r["k"], r["alpha"]) for r in sweep.best_per(table).collect()} == {(15, 1.0), (21, 1.0)}
    with pytest.raises(ValueError):
        Config(weight="inverse")
    with pytest.raises(ValueError):
        runs.pairs(counts, "nothing", Config())


def test_sinks(spark, tmp_path):
    pairs = D.kl_symmetric(frame(spark), 1.0).persist()
    wide = sinks.wide(pairs).collect()
    assert [r["sample"] for r in wide] == sorted(DATA) and wide[0]["a"] == 0.0 and wide[0]["b"] == wide[1]["a"]
    sinks.write_matrix(pairs, str(tmp_path / "m"), "%.6e")
    lines = [x for p in (tmp_path / "m").glob("part*") for x in p.read_text().splitlines()]
    assert len(lines) == 5 and len(lines[0].split()) == 5
    sinks.save_pairs(pairs, str(tmp_path / "p"))
    assert sinks.load_pairs(spark, str(tmp_path / "p"), 5).count() == 10
    with pytest.raises(ValueError):
        sinks.load_pairs(spark, str(tmp_path / "p"), 6)
    sinks.write_csv(pairs, str(tmp_path / "c"), {"d": "%.8f"})
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 10
    made, inputs = [], spark.createDataFrame([("f", 1, "now")], "path string, length long, settings string")
    for _ in range(2):
        assert sinks.cached(spark, str(tmp_path / "k"), inputs, lambda: made.append(1) or frame(spark)).count() == 16
    assert len(made) == 1
    longer = inputs.withColumn("length", F.lit(2).cast("long"))
    assert sinks.cached(spark, str(tmp_path / "k"), longer, lambda: made.append(2) or frame(spark).limit(3)).count() == 3
    assert sinks.cached(spark, str(tmp_path / "k"), inputs, lambda: made.append(3)).count() == 16 and made == [1, 2]
    assert sinks.heatmap_cells(pairs).count() == 25


def test_trees_and_maps(spark):
    d = np.array([[0, 1, 6, 8.0], [1, 0, 5, 7], [6, 5, 0, 2], [8, 7, 2, 0]])
    merges = cluster.average_linkage(d)
    assert merges == [(0, 1, 1.0, 2), (2, 3, 2.0, 2), (4, 5, 6.5, 4)]
    assert cluster.leaf_order(merges, 4) == [0, 1, 2, 3]
    line = np.abs(np.subtract.outer([0, 1, 3.0, 7], [0, 1, 3.0, 7]))
    x, stress = cluster.scaling(line)
    assert stress < 1e-2 * (line**2).sum()
    pairs = D.kl_symmetric(frame(spark), 1.0)
    assert cluster.linkage(pairs)[1].count() == 4 and cluster.scaled(pairs)[0].count() == 5
    with pytest.raises(ValueError):
        cluster.matrix(pairs.limit(3))


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.sampled_from("stuvw"), st.dictionaries(st.sampled_from("abcdefg"), st.integers(1, 9), min_size=1), min_size=2))
def test_properties(spark, data):
    data = {s: Counter(w) for s, w in data.items()}
    counts = frame(spark, data)
    names, c = X.dense(data)
    js = matrix(D.jsd(counts), names)
    assert (js > -1e-12).all() and (js < 1 + 1e-12).all()
    kl, other = matrix(D.kl_symmetric(counts, 0.5), names), matrix(D.kl_symmetric(A.compressed(counts), 0.5), names)
    assert np.allclose(kl, X.symmetric_kl(X.smoothed(c, 0.5)), atol=1e-10) and np.allclose(kl, other, atol=1e-12)
    root = np.sqrt(np.maximum(js, 0))
    for i, j, k in itertools.permutations(range(len(names)), 3):
        assert root[i, j] <= root[i, k] + root[k, j] + 1e-9


def test_sweep_of_several_kinds_is_each_alone(spark):
    counts = frame(spark)
    labels = spark.createDataFrame(list(zip(sorted(DATA), LABELS, strict=True)), "sample string, label string")
    configs = [
        Config(alpha=0.5), Config(alpha=2.0, singletons="exclude"), Config(alpha=0.5, beta=1.0, weight="neglog", scale_weight=True),
        Config(alpha=1.0, beta=2.0, weight="inverse", cap_weight=3.0, clip="directed"), Config(k=21, alpha=0.5),
    ]
    rows = {(r["k"], r["alpha"], r["beta"]): r["silhouette"] for r in sweep.kl_sweep(counts, labels, configs).collect()}
    assert len(rows) == 5
    for c in configs:
        alone = M.overall(M.silhouettes(runs.pairs(counts, "kl", c), labels, c.singletons)).first()[0]
        found = rows[c.k, c.alpha, c.beta]
        # Without the classes of one, one class is left here, which has no score.
        assert math.isnan(found) and math.isnan(alone) if c.singletons == "exclude" else math.isclose(found, alone, rel_tol=1e-9)
    one = labels.withColumn("label", F.lit("one"))
    assert math.isnan(sweep.kl_sweep(counts, one, configs[:1]).first()["silhouette"])
    with pytest.raises(ValueError):
        sweep.kl_sweep(counts, labels, [Config(alpha=0.0)])


def test_sweep_over_k_is_one_plan(spark):
    """All k share one plan, which reads the counts once; before, each k had its own, and each branch of it made the vectors anew."""
    labels = spark.createDataFrame(list(zip(sorted(DATA), LABELS, strict=True)), "sample string, label string")
    read = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    # Of k = 5, every second feature; of k = 7 none.
    both = frame(spark).select(F.explode(F.array(F.lit(3), F.lit(5))).alias("k"), "sample", "feature", "c").where((F.col("k") == 3) | (F.abs(F.hash("feature")) % 2 == 0)).persist()
    counts = both.mapInArrow(told, both.schema)
    configs = sweep.grid(Config(beta=1.0, weight="inverse"), k=(3, 5, 7), alpha=(0.1, 0.5, 1.0, 2.0, 4.0), beta=(1.0, 2.0))
    swept = sweep.kl_sweep_by_k(counts, labels, configs)
    rows = {(r["k"], r["alpha"], r["beta"]): r["silhouette"] for r in swept.collect()}
    assert read.value == both.count() and len(rows) == 30
    for k in (3, 5):
        alone = sweep.kl_sweep(both.where(F.col("k") == k).drop("k"), labels, [c for c in configs if c.k == k])
        for r in alone.collect():
            assert math.isclose(rows[k, r["alpha"], r["beta"]], r["silhouette"], rel_tol=1e-9)
        one = M.overall(M.silhouettes(runs.pairs(both.where(F.col("k") == k).drop("k"), "kl", configs[-1].but(k=k)), labels)).first()[0]
        assert math.isclose(rows[k, 4.0, 2.0], one, rel_tol=1e-9)
    assert rows[3, 4.0, 2.0] != rows[5, 4.0, 2.0] and all(math.isnan(v) for (k, _, _), v in rows.items() if k == 7)
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    few = [c for c in configs if c.beta == 1.0 and c.alpha <= 1.0]
    assert shuffles(sweep.kl_sweep_by_k(counts, labels, few)) == shuffles(sweep.kl_sweep_by_k(counts, labels, [c for c in few if c.k == 3]))


def test_kwip_of_one_weighted_feature(spark):
    n = {"a": 10_007, "b": 10_009, "c": 20_011, "d": 0}
    rows = [(s, "all", 5) for s in n] + [(s, "one", c) for s, c in n.items() if c]
    counts = spark.createDataFrame(rows, "sample string, feature string, c long")
    h = -0.75 * math.log2(0.75) - 0.25 * math.log2(0.25)
    kernel = {(r["sample_i"], r["sample_j"]): r["kernel"] for r in D.kwip_kernel(counts).collect()}
    assert all(v == n[i] * n[j] * kernel["a", "a"] / n["a"] ** 2 or math.isclose(v, n[i] * n[j] * h, rel_tol=1e-15) for (i, j), v in kernel.items())
    for empty, far in ((0.0, math.sqrt(2)), (1.0, 0.0)):
        d = {(r["sample_i"], r["sample_j"]): r["d"] for r in D.kwip_distance(D.kwip_kernel(counts), empty).collect()}
        assert all(d[p, "d"] == far for p in "abc")
