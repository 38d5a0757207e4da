"""Hard-negative mining: product codes with stored residual norms bound every score, and exact integer products decide within the bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors that the codes are fitted on, at most, and bytes of them: a bound on what reaches the driver. Every vector is coded.
FIT, FIT_BYTES = 8_192, 32_000_000
#: Components of a subspace, centers in it (a code is a byte), and rounds of k-means.
SUB, CENTERS, ROUNDS = 2, 256, 5
#: Anchors of one cell, rows that its task takes from it in the long run, at the least, and at once.
ANCHORS, STRIPE, LEAST, CHUNK = 512, 65_536, 4_096, 4_096
#: Statistics of labels are broadcast up to so many rows, and joined by shuffle beyond.
FEW = 50_000
#: Largest long; scores beyond it count as that, with their sign.
MOST = 2**63 - 1


class Codebook:
    """Centers of each subspace of the vectors of each length."""

    def __init__(self, samples: dict[int, np.ndarray], seed: int = 12):
        rng = np.random.default_rng(seed)
        self.centers = {size: np.stack([self._means(part, rng) for part in self._parts(x).transpose(1, 0, 2)]) for size, x in samples.items() if size}

    @staticmethod
    def _parts(x: np.ndarray) -> np.ndarray:
        """Vectors cut into subspaces, the last one filled up with zeros: (vectors, subspaces, SUB)."""
        many = -(-x.shape[1] // SUB)
        return np.pad(x, ((0, 0), (0, many * SUB - x.shape[1]))).reshape(len(x), many, SUB)

    @staticmethod
    @np.errstate(over="ignore", invalid="ignore")
    def _means(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        centers = np.zeros((CENTERS, SUB))
        many = min(CENTERS, len(x))
        centers[:many] = x[rng.permutation(len(x))[:many]]
        for _ in range(ROUNDS):
            own = np.argmax(x @ centers.T - (centers**2).sum(1) / 2, axis=1)
            count = np.bincount(own, minlength=CENTERS)
            for c in range(SUB):
                total = np.bincount(own, x[:, c], CENTERS)
                centers[count > 0, c] = total[count > 0] / count[count > 0]
        return centers

    def of(self, size: int) -> np.ndarray:
        """(subspaces, CENTERS, SUB); a length that the sample didn't hold has one center, 0."""
        return self.centers[size] if size in self.centers else np.zeros((-(-size // SUB), 1, SUB))

    @np.errstate(over="ignore", invalid="ignore")
    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, norms of the residuals, rounded up) of vectors of one length, by subspace."""
        parts, centers = self._parts(x), self.of(x.shape[1])
        codes, rest = np.zeros(parts.shape[:2], np.uint8), np.zeros(parts.shape[:2], np.float32)
        for m, own in enumerate(centers):
            at = np.argmax(parts[:, m] @ own.T - (own**2).sum(1) / 2, axis=1)
            codes[:, m] = at
            exact = np.sqrt(((parts[:, m] - own[at]) ** 2).sum(1))
            rest[:, m] = np.nextafter((exact * (1 + 1e-9)).astype(np.float32), np.float32(np.inf))
        return codes, rest

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(products of each query with each center, norms of each query) by subspace."""
        parts = self._parts(q)
        return np.einsum("qms,mcs->mqc", parts, self.of(q.shape[1])), np.sqrt((parts**2).sum(2))


@np.errstate(over="ignore", invalid="ignore")
def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer inner products of whole-numbered vectors. Sums that doubles hold exactly are made in doubles, others in Python's integers."""
    if not len(x):
        return np.zeros(0, np.int64)
    if np.sqrt((q * q).sum() * (x * x).sum(1).max()) < 2**52:
        return (x @ q).astype(np.int64)
    whole = [int(v) for v in q]
    return np.array([max(-MOST, min(MOST, sum(int(a) * b for a, b in zip(row, whole, strict=True)))) for row in x], np.int64)


class Asked:
    """The anchors of a cell, each with its windows of scores, and the best rows in each window so far."""

    def __init__(self, book: Codebook, table: dict, same: bool, k: int, low: int, high: int):
        self.rows, self.names, self.labels, self.q, self.same, self.k = table["row"], table["vec_id"], table["label"], table["vector"], same, k
        self.products, self.norms = book.tables(self.q)
        self.length = np.sqrt((self.q**2).sum(1))
        self.windows, self.found = [], []
        for scores in table["scores"]:
            # Without a positive's score the window is open. Bounds are whole numbers, so they are rounded inwards.
            self.windows.append([(-math.inf, math.inf) if s is None else (-((-low * s) // 100), (high * s) // 100) for s in scores])
            self.found.append([(np.zeros(0, np.int64),) * 3 for _ in scores])

    @np.errstate(over="ignore", invalid="ignore")
    def take(self, rows: np.ndarray, names: np.ndarray, labels: np.ndarray, codes: np.ndarray, rest: np.ndarray, vectors: np.ndarray) -> None:
        """Rows that may reach the best k of a window: the looked-up score plus the residual bound reaches both the window and its
        k-th best so far, or k rows are sure to be better; less that bound it lies below the window's end. Those are scored exactly."""
        near = np.zeros((len(self.q), len(rows)))
        for m, table in enumerate(self.products):
            near += table[:, codes[:, m]]
        length = np.sqrt((vectors**2).sum(1)).max(initial=0.0)
        slack = 1e-9 * self.length[:, None] * length + 1e-6
        bound = self.norms @ rest.T.astype(np.float64) + slack
        for i, windows in enumerate(self.windows):
            fine = (labels == self.labels[i]) & (rows != self.rows[i]) if self.same else labels != self.labels[i]
            least, most = near[i] - bound[i], near[i] + bound[i]
            least[np.isnan(least)], most[np.isnan(most)] = -np.inf, np.inf  # beyond what doubles hold there are no bounds
            wanted = np.zeros(len(rows), bool)
            for (low, high), held in zip(windows, self.found[i], strict=True):
                sure = least[fine & (least >= low) & (most <= high)]
                floor = max(low, np.partition(sure, -self.k)[-self.k] if len(sure) >= self.k else -math.inf, held[0][-1] if len(held[0]) == self.k else -math.inf)
                wanted |= fine & (most >= floor) & (least <= high)
            at = np.flatnonzero(wanted)
            if not len(at):
                continue
            scores = exact(vectors[at], self.q[i])
            for w, (low, high) in enumerate(windows):
                within = (scores >= low) & (scores <= high)
                both = [np.concatenate(x) for x in zip(self.found[i][w], (scores[within], names[at][within], rows[at][within]), strict=True)]
                best = np.lexsort((both[2], both[1], -both[0]))[: self.k]
                self.found[i][w] = tuple(x[best] for x in both)

    def batch(self) -> pa.RecordBatch:
        flat = [(int(self.rows[i]), int(self.names[i]), w, *found) for i, each in enumerate(self.found) for w, found in enumerate(each)]
        many = [len(f[3]) for f in flat]
        column = lambda c: np.repeat(np.array([f[c] for f in flat], np.int64), many)
        part = lambda c: np.concatenate([f[c] for f in flat] or [np.zeros(0, np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(column(0)), pa.array(column(1)), pa.array(column(2).astype(np.int32)), pa.array(part(5)), pa.array(part(4)), pa.array(part(3))], ["anchor_row", "anchor_id", "window", "row", "vec_id", "score"])


def _whole(rows: DataFrame, scale: float) -> DataFrame:
    """(vec_id, label, size, vector, norm, most, row) of the rows that take part, the vector's components being floor(scale x x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, size, vector, most = [], [], [], []
            for i, v in enumerate(batch.column(2)):
                if not v.is_valid or v.values.null_count:
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(scale * v.values.to_numpy(zero_copy_only=False).astype(np.float64)) + 0.0
                if np.isfinite(x).all():
                    at.append(i)
                    size.append(len(x))
                    vector.append(x.tobytes())
                    most.append(float(np.abs(x).max(initial=0.0)))
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:2], pa.array(size, pa.int32()), pa.array(vector, pa.binary()), pa.array(most, pa.float64())], ["vec_id", "label", "size", "vector", "most"])

    clean = rows.where("vec_id is not null and label is not null and embedding is not null").mapInArrow(run, "vec_id long, label string, size int, vector binary, most double")
    return written(clean.withColumn("row", F.monotonically_increasing_id()), "whole")


def _matrix(column: pa.Array, kind: str, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), size)


def _coded(whole: DataFrame, sent, packed: str) -> DataFrame:
    """(row, vec_id, label, size, codes, rest, vector), the vector packed as small as all vectors allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            for size in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == size))
                x = _matrix(part.column(4), "<f8", size)
                codes, rest = sent.value.coded(x)
                made = [pa.array([r.tobytes() for r in a], pa.binary()) for a in (codes, rest, x.astype(packed))]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *made], ["row", "vec_id", "label", "size", "codes", "rest", "vector"])

    return written(whole.select("row", "vec_id", "label", "size", "vector").mapInArrow(run, "row long, vec_id long, label string, size int, codes binary, rest binary, vector binary"), "coded")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """(cell, side, rows) of stretches of a sorted stream that agree in both."""
    for batch in batches:
        cells, sides = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
        cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (sides[1:] != sides[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)], strict=True):
            if a < b:
                yield cells[a], int(sides[a]), batch.slice(a, b - a)


def _best(coded: DataFrame, anchors: DataFrame, sent, packed: str, same: bool, k: int, low: int, high: int) -> DataFrame:
    """(anchor_row, anchor_id, window, row, vec_id, score, rank): the k best rows of each window of each anchor (with `scores`).

    Rows meet anchors of their length, and of their label if `same`, in cells of about ANCHORS anchors and at most about
    STRIPE rows: both are dealt by hash, so a label or a length that most rows have is many cells. A task takes a cell's rows
    as they come, and passes on k rows a window at most.
    """
    spark = coded.sparkSession
    home = ["size", *(["label"] if same else [])]
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = coded.groupBy(*home).agg(F.count("*").alias("rows"))
    plan = anchors.groupBy(*home).agg(F.ceil(F.count("*") / ANCHORS).alias("blocks")).join(rows, home)
    wanted = F.greatest(F.ceil(F.col("rows") / STRIPE), F.least(F.ceil(F.col("rows") / LEAST), F.ceil(F.lit(tasks) / F.col("blocks"))))
    plan = written(plan.select(*home, F.col("blocks").cast("int").alias("blocks"), wanted.cast("int").alias("stripes")), "plan")
    plan = F.broadcast(plan) if plan.count() <= FEW else plan
    place = lambda column, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.col(column)).cast("int")
    named = lambda block, stripe: F.concat_ws("|", "size", block, stripe, *home[1:])
    left = anchors.join(plan, home).withColumn("stripe", F.explode(F.expr("sequence(0, stripes - 1)"))).withColumn("block", place("blocks", 5))
    right = coded.join(plan, home).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("stripe", place("stripes", 3))
    cell = named("block", "stripe").alias("cell")
    left = left.select(cell, F.lit(0).alias("side"), "row", "vec_id", "label", "size", "codes", "rest", "vector", "scores")
    right = right.select(cell, F.lit(1).alias("side"), "row", "vec_id", "label", "size", "codes", "rest", "vector", F.lit(None).cast("array<long>").alias("scores"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asking, asked, held = None, [], None, []

        def read(parts: list[pa.RecordBatch]) -> dict:
            table = pa.Table.from_batches(parts).combine_chunks()
            size = table["size"][0].as_py()
            subspaces = -(-size // SUB)
            out = {c: table[c].to_numpy() for c in ("row", "vec_id")} | {"label": np.array(table["label"].to_pylist(), object), "scores": table["scores"].to_pylist()}
            return out | {"vector": _matrix(table["vector"], packed, size).astype(np.float64), "codes": _matrix(table["codes"], "u1", subspaces), "rest": _matrix(table["rest"], "<f4", subspaces)}

        def work() -> None:
            nonlocal asked, held
            if asked is None and asking:
                asked = Asked(sent.value, read(asking), same, k, low, high)
            if asked is not None and held:
                table = read(held)
                asked.take(*(table[c] for c in ("row", "vec_id", "label", "codes", "rest", "vector")))
            held = []

        for cell, side, part in _runs(batches):
            if cell != now:
                work()
                if asked is not None:
                    yield asked.batch()
                now, asking, asked = cell, [], None
            (held if side else asking).append(part)
            if side and sum(map(len, held)) >= CHUNK:
                work()
        work()
        if asked is not None:
            yield asked.batch()

    dealt = left.unionByName(right).repartition("cell").sortWithinPartitions("cell", "side")
    found = dealt.mapInArrow(scan, "anchor_row long, anchor_id long, window int, row long, vec_id long, score long")
    order = Window.partitionBy("anchor_row", "window").orderBy(F.col("score").desc(), F.col("vec_id").asc(), F.col("row").asc())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    divisor: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale x component); a row's score is its integer inner product with the anchor, the larger the
    better, ties going to the smaller id. Anchors are the rows whose id is divisible by divisor, an anchor's positives the
    first other rows of its label, fewer if there are fewer. For each of them come the first rows of other labels with
    low x positive_score <= 100 x negative_score <= high x positive_score, fewer or none if there are fewer.

    All is exact: a product code of each vector gives its scores but for the residuals, whose norms are stored and bound the
    difference, and what the bounds leave open is scored by whole numbers. The codes are fitted on at most FIT vectors.

    Rows without an id, a label or a vector, or with a component that is null, not finite, or infinite once scaled, take no
    part. Zero vectors do, and empty ones, which score 0. Only vectors of one length meet. An id may repeat: its rows are
    rows of their own, so that an anchor that two rows have is answered twice. Scores beyond a long count as the nearest
    long. Other columns are left out. No usable rows: no rows.
    """
    spark = rows.sparkSession
    given = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").alias("embedding"))
    whole = _whole(given, scale)
    size, most = whole.agg(F.max("size"), F.max("most")).first()
    packed = "<i2" if (most or 0) < 2**15 else "<i4" if most < 2**31 else "<f8"
    fit = max(CENTERS, min(FIT, FIT_BYTES // (8 * max(1, size or 0))))
    drawn: dict[int, list] = {}
    for r in whole.orderBy(F.xxhash64("row", F.lit(9)), "row").limit(fit).select("size", "vector").collect():
        drawn.setdefault(r["size"], []).append(np.frombuffer(r["vector"]))
    sent = spark.sparkContext.broadcast(Codebook({s: np.stack(x) for s, x in drawn.items()}))
    coded = _coded(whole, sent, packed)
    anchors = coded.where(F.col("vec_id") % divisor == 0)
    open_ = F.array(F.lit(None).cast("long")).alias("scores")
    first = _best(coded, anchors.select("*", open_), sent, packed, True, positives, low, high)
    first = written(first.select("anchor_row", F.col("rank").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # At most `positives` of each anchor, in order: a window a positive.
    listed = first.groupBy(F.col("anchor_row").alias("row")).agg(F.transform(F.array_sort(F.collect_list(F.struct("positive", "positive_score"))), lambda p: p["positive_score"]).alias("scores"))
    second = _best(coded, anchors.join(listed, "row"), sent, packed, False, negatives, low, high)
    named = second.withColumn("positive", F.col("window") + 1).join(first, ["anchor_row", "positive"])
    return named.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
