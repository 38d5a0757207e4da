"""Nearest neighbours by inner product: probed lists, scanned a block of dimensions at a time with early abandonment."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .vectors import runs, usable

#: Vectors that the lists are fitted on, and of these the ones that give each query its first bound. Both are bounds on what
#: reaches the driver; every vector is indexed.
FIT, FIRST = 20_000, 256
#: Vectors of the fitted sample to a center, at least.
SUPPORT = 64
#: Lists that are scanned first, to raise each query's bound before its other lists are.
LEAD = 3
#: Vectors in a block of a list, queries that meet it in one task, and dimensions in a column block.
BLOCK, QUERIES, COLUMNS = 1_024, 512, 16
#: A candidate is abandoned when its partial product stays this many deviations of the rest below the bound.
DEVIATIONS = 4.0
#: Of the neighbours within the fitted sample, the share that the probed lists must hold.
HELD = 0.97


class Index:
    """Lists, a rotation and the number of lists to probe, fitted on a bounded sample.

    A list is a center. The lists grow with the square root of the table; where the sample can't hold up so many centers, a
    list is a center and one of a second set, fitted on what the vectors differ from their centers by, so that the lists are
    all sums of the two.
    """

    def __init__(self, sample: np.ndarray, total: int, k: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        n, d = sample.shape
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        wanted = max(1, math.isqrt(total) // 2)
        most = max(1, n // SUPPORT)
        self.centers = self._means(sample, min(wanted, most), rng)
        self.second = np.zeros((1, d))
        if wanted > most:
            rest = sample - self.centers[_nearest(sample, self.centers)]
            self.second = self._means(rest, min(most, -(-wanted // most)), rng)
        own = self.place(sample)
        asked = rng.permutation(n)[:256]
        products = sample[asked] @ sample.T
        products[np.arange(len(asked)), asked] = -np.inf
        near = np.argpartition(-products, min(k, n - 1) - 1, axis=1)[:, : min(k, n - 1)] if n > 1 else np.zeros((len(asked), 0), np.int64)
        places = []
        for q, found in zip(sample[asked], near, strict=True):
            rank = np.empty(self.lists, np.int64)
            rank[self.order(q)] = np.arange(self.lists)
            places += rank[own[found]].tolist()
        self.probes = min(self.lists, int(np.quantile(places, HELD)) + 1) if places else self.lists

    @property
    def lists(self) -> int:
        return len(self.centers) * len(self.second)

    @staticmethod
    def _means(x: np.ndarray, many: int, rng: np.random.Generator) -> np.ndarray:
        """Centers of x by eight rounds of k-means."""
        centers = x[rng.permutation(len(x))[:many]].copy()
        for _ in range(8):
            own = _nearest(x, centers)
            sums = np.zeros_like(centers)
            np.add.at(sums, own, x)
            count = np.bincount(own, minlength=many)
            centers[count > 0] = sums[count > 0] / count[count > 0, None]
        return centers

    def place(self, x: np.ndarray) -> np.ndarray:
        """The list of each vector."""
        first = _nearest(x, self.centers)
        return first * len(self.second) + _nearest(x - self.centers[first], self.second)

    def order(self, q: np.ndarray) -> np.ndarray:
        """All lists, those first whose centers have the largest product with q."""
        return np.argsort(-((self.centers @ q)[:, None] + self.second @ q).reshape(-1), kind="stable")


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = (centers**2).sum(1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centers.T - half, axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed alike for every row, so that equal vectors tie."""
    return (x * q).sum(axis=1)


def best(scores: np.ndarray, names: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores; of equal ones the smaller names come first, and of those the smaller rows."""
    return np.lexsort((rows, names, -scores))[:k]


class Scanner:
    """One block of a list, rotated and stored in blocks of columns."""

    def __init__(self, rows: np.ndarray, names: np.ndarray, vectors: np.ndarray, rotation: np.ndarray):
        self.rows, self.names, self.vectors = rows, names, vectors
        turned = vectors @ rotation
        cuts = list(range(0, turned.shape[1], COLUMNS))
        self.parts = [np.ascontiguousarray(turned[:, c : c + COLUMNS]) for c in cuts]
        square = np.stack([(p**2).sum(1) for p in self.parts], axis=1)
        self.rest = np.sqrt(np.maximum(0.0, square[:, ::-1].cumsum(1)[:, ::-1] - square))

    def search(self, q: np.ndarray, turned: np.ndarray, row: int, bound: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, scores) of up to k vectors that reach the bound, but not the query's own row.

        After each block of columns, the rest of the product is taken for normal with the deviation that a random rotation
        gives it; a candidate whose product would have to exceed it by DEVIATIONS is abandoned.
        """
        alive = np.flatnonzero(self.rows != row)
        product, done = np.zeros(len(alive)), 0
        for i, part in enumerate(self.parts):
            width = part.shape[1]
            product = product + (part[alive] if len(alive) < len(part) else part) @ turned[done : done + width]
            done += width
            left = len(turned) - done
            if left and math.isfinite(bound):
                slack = DEVIATIONS / math.sqrt(left) * float(np.sqrt((turned[done:] ** 2).sum()))
                keep = product + np.minimum(slack, float(np.sqrt((turned[done:] ** 2).sum()))) * self.rest[alive, i] >= bound - 1e-9
                alive, product = alive[keep], product[keep]
        scores = exact(self.vectors[alive], q)
        at = best(scores, self.names[alive], self.rows[alive], k)
        at = at[scores[at] >= bound]
        return alive[at], scores[at]


def search(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", divisor: int = 20, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose id is divisible by divisor.

    Nearness is the inner product in double precision, ties go to the smaller id, and every row but the query's own is a
    candidate. An id may repeat: its rows are candidates, and queries, of their own, so that a query id that two rows have
    is answered twice. Vectors that are null, empty, zero, or hold a null or a component that is not finite take no part,
    nor do rows without an id; vectors of another length than the query's are no candidates. A query with fewer than k
    candidates has them all. No usable rows: no rows. Other columns are left out.

    Lists and the number of probes are fitted on FIT vectors, spread by hash; each query's bound is its k-th best of FIRST
    of them, which are candidates too, and then of its LEAD nearest lists. All vectors are indexed, at every size of the
    table in the same way. A list's vectors are dealt to blocks of about BLOCK and its queries to blocks of about QUERIES,
    so a crowded list is scanned by many tasks.
    """
    spark = rows.sparkSession
    given = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).where("vec_id is not null")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, vectors = usable(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([len(v) for v in vectors], pa.int32()), pa.array([v.tobytes() for v in vectors], pa.binary())], ["vec_id", "size", "vector"])

    usable_rows = given.mapInArrow(clean, "vec_id long, size int, vector binary").withColumn("row", F.monotonically_increasing_id())
    usable_rows = written(usable_rows, "vectors")
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # A row a length of vectors; as a rule there is one.
    for found in usable_rows.groupBy("size").count().orderBy("size").collect():
        out = out.unionByName(_search(usable_rows.where(F.col("size") == found["size"]).select("row", "vec_id", "vector"), found["count"], divisor, k))
    return out


def _search(base: DataFrame, total: int, divisor: int, k: int) -> DataFrame:
    """The same for (row, vec_id, vector) of one length."""
    spark = base.sparkSession
    spread = F.xxhash64("row", F.lit(3))
    drawn = base.orderBy(spread, "row").limit(FIT).collect()
    sample = np.stack([np.frombuffer(r["vector"]) for r in drawn])
    index = Index(sample, total, k)
    start = np.array([r["row"] for r in drawn[:FIRST]], np.int64), np.array([r["vec_id"] for r in drawn[:FIRST]], np.int64), sample[:FIRST]
    sent = spark.sparkContext.broadcast((index, *start))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value[0]
        for batch in batches:
            if len(batch):
                x = np.stack([np.frombuffer(v) for v in batch.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([pa.array(index.place(x).astype(np.int32)), *batch.columns], ["list", "row", "vec_id", "vector"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, rows, names, first = sent.value
        for batch in batches:
            lists, bounds, near, near_rows, scores = [], [], [], [], []
            for row, vector in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                q = np.frombuffer(vector)
                others = np.flatnonzero(rows != row)
                score = exact(first[others], q)
                at = best(score, names[others], rows[others], k)
                lists.append(index.order(q)[: index.probes].astype(np.int32))
                bounds.append(float(score[at[-1]]) if len(at) == k else -math.inf)
                near.append(names[others[at]])
                near_rows.append(rows[others[at]])
                scores.append(score[at])
            made = [pa.array(lists, pa.list_(pa.int32())), pa.array(bounds, pa.float64()), pa.array(near_rows, pa.list_(pa.int64())), pa.array(near, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], ["query_row", "query_id", "vector", "lists", "bound", "row", "vec_id", "score"])

    questions = base.where(F.col("vec_id") % divisor == 0).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "row")
    questions = written(questions.mapInArrow(asked, "query_row long, query_id long, vector binary, lists array<int>, bound double, row array<long>, vec_id array<long>, score array<double>"), "questions")
    known = questions.select("query_row", "query_id", F.explode(F.arrays_zip("row", "vec_id", "score")).alias("n")).select("query_row", "query_id", "n.row", "n.vec_id", "n.score")
    listed = written(base.mapInArrow(placed, "list int, row long, vec_id long, vector binary"), "lists")
    sizes = listed.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    probes = questions.select(F.explode("lists").alias("list")).groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("asking"))
    blocks = written(sizes.join(probes, "list"), "blocks")  # a row a list: their number is that of the index, which is sent out as well
    dealt = listed.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(spread, F.col("blocks")).cast("int"))
    stored = dealt.select("list", "block", F.explode(F.expr("sequence(0, asking - 1)")).alias("part"), F.lit(0).alias("side"), "row", "vec_id", "vector", F.lit(0.0).alias("bound"))

    def probing(questions: DataFrame, first: int, many: int) -> DataFrame:
        rows = questions.select("query_row", "query_id", "vector", "bound", F.explode(F.slice("lists", first + 1, many)).alias("list")).join(F.broadcast(blocks), "list")
        part = F.pmod(F.xxhash64("query_row", F.lit(5)), F.col("asking")).cast("int").alias("part")
        return rows.select("list", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), part, F.lit(1).alias("side"), F.col("query_row").alias("row"), F.col("query_id").alias("vec_id"), "vector", "bound")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation = sent.value[0].rotation
        for _, rows in runs(batches, 3):
            cut = sum(r[0] == 0 for r in rows)
            rows.sort(key=lambda r: r[0])
            if not 0 < cut < len(rows):
                continue
            scanner = Scanner(np.array([r[1] for r in rows[:cut]], np.int64), np.array([r[2] for r in rows[:cut]], np.int64), np.stack([np.frombuffer(r[3]) for r in rows[:cut]]), rotation)
            out = [], [], [], [], []
            for _, row, name, vector, bound in rows[cut:]:
                q = np.frombuffer(vector)
                at, scores = scanner.search(q, q @ rotation, row, bound, k)
                for held, new in zip(out, (np.full(len(at), row, np.int64), np.full(len(at), name, np.int64), scanner.rows[at], scanner.names[at], scores), strict=True):
                    held.append(new)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["query_row", "query_id", "row", "vec_id", "score"])

    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc(), F.col("row").asc())

    def scan(probes: DataFrame, known: DataFrame) -> DataFrame:
        rows = stored.unionByName(probes).repartition("list", "block", "part").sortWithinPartitions("list", "block", "part", "side")
        hits = rows.mapInArrow(scanned, "query_row long, query_id long, row long, vec_id long, score double")
        found = hits.unionByName(known).dropDuplicates(["query_row", "row"])
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    known = written(scan(probing(questions, 0, LEAD), known).drop("rank"), "first")
    bounds = known.groupBy("query_row").agg(F.when(F.count("*") >= k, F.min("score")).alias("raised"))
    raised = questions.join(bounds, "query_row").withColumn("bound", F.coalesce("raised", "bound"))
    return scan(probing(raised, LEAD, index.lists), known).select("query_id", "rank", "vec_id", "score")


def all_pairs(rows: np.ndarray, names: np.ndarray, asked: np.ndarray, k: int) -> list[tuple[int, list[int]]]:
    """The exact answer, to measure recall by."""
    out = []
    for i in asked:
        scores = exact(rows, rows[i])
        others = np.flatnonzero(np.arange(len(rows)) != i)
        out.append((int(names[i]), names[others[best(scores[others], names[others], others, k)]].tolist()))
    return out
