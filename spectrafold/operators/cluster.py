"""Trees and maps of the samples from their distances.

linkage() and scaled() work on the pairs as they are, in rounds; what is kept of them on the driver is nothing, or a point for
each sample. The functions on a matrix do the same in plain numpy, for what is plotted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.shared import written
from .order import ranked

#: Most samples whose matrix is taken to the driver.
MOST = 2_000


def matrix(pairs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(names in order, symmetric matrix) of pairs i < j; raises ValueError beyond MOST samples or where pairs are absent."""
    rows = pairs.select("sample_i", "sample_j", "d").limit(MOST * (MOST - 1) // 2 + 1).collect()
    names = sorted({r[0] for r in rows} | {r[1] for r in rows})
    if len(names) > MOST or len(rows) != len(names) * (len(names) - 1) // 2:
        raise ValueError(f"a whole matrix of up to {MOST} samples is needed")
    at = {n: i for i, n in enumerate(names)}
    out = np.zeros((len(names), len(names)))
    for i, j, d in rows:
        out[at[i], at[j]] = out[at[j], at[i]] = d
    return names, out


def average_linkage(distances: np.ndarray) -> list[tuple[int, int, float, int]]:
    """Merges (a, b, height, size): the two clusters with the least mean distance, until one is left.

    Samples are clusters 0 to n - 1, the k-th merge makes cluster n + k. Ties go to the smaller numbers.
    """
    n = len(distances)
    d = distances.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    number, size = list(range(n)), [1] * n
    alive = list(range(n))
    out = []
    for k in range(n - 1):
        sub = d[np.ix_(alive, alive)]
        best = sub.min()
        ties = np.argwhere(sub <= best)
        x, y = min(((alive[i], alive[j]) for i, j in ties if i != j), key=lambda p: tuple(sorted((number[p[0]], number[p[1]]))))
        a, b = sorted((x, y), key=lambda i: number[i])
        out.append((number[a], number[b], float(best), size[a] + size[b]))
        merged = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = merged, merged
        d[a, a] = np.inf
        number[a], size[a] = n + k, size[a] + size[b]
        alive.remove(b)
    return out


def leaf_order(merges: list[tuple[int, int, float, int]], n: int) -> list[int]:
    """Samples from left to right in the tree."""
    if not merges:
        return list(range(n))
    below = {i: [i] for i in range(n)}
    for k, (a, b, _, _) in enumerate(merges):
        below[n + k] = below.pop(a) + below.pop(b)
    return below[n + len(merges) - 1]


def scaling(distances: np.ndarray, dims: int = 2, rounds: int = 300, seed: int = 42) -> tuple[np.ndarray, float]:
    """(coordinates, stress): multidimensional scaling by majorisation, from a seeded start."""
    n = len(distances)
    x = np.random.default_rng(seed).standard_normal((n, dims))
    last = np.inf
    for _ in range(rounds):
        gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        ratio = np.where(gap > 1e-12, distances / np.where(gap > 1e-12, gap, 1), 0.0)
        b = -ratio
        b[np.arange(n), np.arange(n)] = ratio.sum(1)
        x = b @ x / max(n, 1)
        gap = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        stress = float(((gap - distances) ** 2).sum() / 2)
        if last - stress < 1e-9 * max(1.0, stress):
            break
        last = stress
    return x, stress


def numbered(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, pairs) with samples numbered from 0 by name: names (id, sample), pairs (a, b, d) for a < b; a whole matrix is needed."""
    names = pairs.select(F.col("sample_i").alias("sample")).union(pairs.select("sample_j")).distinct()
    names = written(ranked(names, [F.col("sample")]).select((F.col("place") - 1).alias("id"), "sample"), "names")
    i, j = names.select(F.col("id").alias("a"), F.col("sample").alias("sample_i")), names.select(F.col("id").alias("b"), F.col("sample").alias("sample_j"))
    both = written(pairs.join(i, "sample_i").join(j, "sample_j").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d"), "numbered")
    n = names.count()
    if both.distinct().count() != n * (n - 1) // 2:
        raise ValueError("a distance for each pair of samples is needed")
    return names, both


def linkage(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names (id, sample), merges (step, a, b, height, size)): average linkage, from pairs alone.

    In each round all pairs of clusters that are nearest to one another are merged, wherever they are: as the mean distance to
    a merged cluster is never below the least of the two, that gives the same tree as merging the closest two of all. The
    pairs between clusters are added up anew after each round, and become fewer. Steps are by height, as are the numbers of
    clusters: samples have 0 to n - 1, the k-th merge makes n + k. Of equal distances, those of smaller numbers come first.
    """
    names, now = numbered(pairs)
    n = names.count()
    now = now.select("a", "b", F.col("d").cast("double").alias("total"), F.lit(1).cast("long").alias("many"))
    sizes = names.select(F.col("id"), F.lit(1).cast("long").alias("size"))
    merges, turn = None, 0
    while not now.isEmpty():
        mean = F.named_struct(F.lit("height"), F.col("total") / F.col("many"), F.lit("a"), F.col("a"), F.lit("b"), F.col("b"))
        each = now.select(mean.alias("m"), F.explode(F.array("a", "b")).alias("own")).groupBy("own").agg(F.min("m").alias("m"))
        # A cluster goes by the smallest number in it. A pair that both of its clusters name is merged.
        pairs_ = each.groupBy("m").agg(F.count("*").alias("named")).where("named = 2").select("m.a", "m.b", "m.height")
        left, right = sizes.select(F.col("id").alias("a"), F.col("size").alias("size_a")), sizes.select(F.col("id").alias("b"), F.col("size").alias("size_b"))
        found = written(pairs_.join(left, "a").join(right, "b").select(F.lit(turn).alias("turn"), "a", "b", "height", (F.col("size_a") + F.col("size_b")).alias("size")), "merged")
        merges = found if merges is None else merges.unionByName(found)
        gone = found.select(F.col("b").alias("old"), F.col("a").alias("new"))
        renamed = now
        for c in ("a", "b"):
            renamed = renamed.join(gone, F.col(c) == F.col("old"), "left").withColumn(c, F.coalesce("new", c)).drop("old", "new")
        renamed = renamed.where("a != b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        now = written(renamed.agg(F.sum("total").alias("total"), F.sum("many").alias("many")), "between")
        grown = sizes.join(found.select(F.col("a").alias("id"), F.col("size").alias("grown")), "id", "left").join(gone.select(F.col("old").alias("id")), "id", "left_anti")
        sizes = written(grown.select("id", F.coalesce("grown", "size").alias("size")), "sizes")
        turn += 1
    if merges is None:
        merges = now.select(F.lit(0).alias("turn"), "a", "b", F.col("total").alias("height"), F.col("many").alias("size"))
    steps = written(ranked(merges, [F.col("height"), F.col("turn"), F.col("a")]).withColumn("step", F.col("place") - 1).drop("place"), "steps")
    # What a cluster's number stood for before: its merge of an earlier round, or the sample.
    own = Window.partitionBy("a").orderBy("turn")
    last = steps.groupBy(F.col("a").alias("b")).agg((F.max_by("step", "turn") + n).alias("second"))
    first = F.coalesce(F.lag("step").over(own) + n, F.col("a"))
    out = steps.withColumn("first", first).join(last, "b", "left").withColumn("second", F.coalesce("second", "b"))
    return names, out.select("step", F.least("first", "second").alias("a"), F.greatest("first", "second").alias("b"), "height", "size")


def scaled(pairs: DataFrame, dims: int = 2, starts: int = 20, rounds: int = 60, least: float = 1e-5, seed: int = 42) -> tuple[DataFrame, float]:
    """(points (sample, x0, x1, ...), stress): multidimensional scaling of pairs that are never brought to one place.

    The start is classical scaling by subspace iteration, then stress is majorised until a round lowers it by less than the
    share `least`. A round is one pass over the pairs, which knows all points, and returns a point for each sample.
    """
    names, near = numbered(pairs)
    n, spark = names.count(), pairs.sparkSession
    near = near.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), F.col("d").cast("double").alias("d"))

    def added(points: np.ndarray, weight) -> tuple[np.ndarray, float]:
        """(sums over the pairs of each sample, sum of the last) of what weight gives for the two ends of pairs."""
        sent = spark.sparkContext.broadcast(points)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, total = np.zeros((n, dims)), 0.0
            for batch in batches:
                a, b, d = (c.to_numpy() for c in batch.columns)
                to_a, to_b, more = weight(sent.value[a], sent.value[b], d)
                np.add.at(sums, a, to_a)
                np.add.at(sums, b, to_b)
                total += more
            at = np.flatnonzero(sums.any(1))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at, n)), pa.array(np.vstack([sums[at], np.full((1, dims), total)]).tolist(), pa.list_(pa.float64()))], ["id", "sums"])

        each = near.mapInArrow(run, "id long, sums array<double>")
        out, total = np.zeros((n, dims)), 0.0
        for r in each.groupBy("id").agg(F.array(*(F.sum(F.col("sums")[i]) for i in range(dims))).alias("sums")).collect():
            if r["id"] < n:
                out[r["id"]] = r["sums"]
            else:
                total = r["sums"][0]
        return out, total

    def square(p: np.ndarray, q: np.ndarray, d: np.ndarray):
        return -0.5 * (d * d)[:, None] * q, -0.5 * (d * d)[:, None] * p, 0.0

    def gaps(p: np.ndarray, q: np.ndarray, d: np.ndarray):
        gap = np.sqrt(((p - q) ** 2).sum(1))
        pull = np.where(gap > 1e-12, d / np.where(gap > 1e-12, gap, 1), 0.0)[:, None] * (p - q)
        return pull, -pull, float(((gap - d) ** 2).sum())

    x = np.random.default_rng(seed).standard_normal((n, dims))
    x -= x.mean(0)
    for _ in range(starts if n > dims else 0):
        basis, _ = np.linalg.qr(x)
        x = added(basis, square)[0]
        x -= x.mean(0)
    if n > dims:
        basis, r = np.linalg.qr(x)
        x = basis * np.sqrt(np.abs(np.diag(r)))
    stress = np.inf
    for _ in range(rounds):
        new, now = added(x, gaps)
        if stress - now <= least * now:
            stress = now
            break
        x, stress = new / max(n, 1), now
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], f"id long, {', '.join(f'x{i} double' for i in range(dims))}")
    return names.join(points, "id").drop("id"), float(stress)
