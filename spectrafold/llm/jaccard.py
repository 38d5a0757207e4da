"""N-gram Jaccard join: a blocked sparse product of documents by shingles, cut down by bounds from the sizes of the sets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, free, held, text_of, written
from .shingles import mixed, shingle_sets
from .vectors import roots, runs

#: Counters of the sketch of shingle frequencies (a power of two), and counters that travel in one row.
BINS, BLOCK = 1 << 20, 1 << 14
#: Bits of the filter that picks the sets to be compared.
FILTER_BITS = 1 << 24
#: Columns of the product with more rows than this join documents to a cluster without listing pairs.
HOT = 64
#: Documents and shingles of one block of a large cluster.
BLOCK_DOCS, BLOCK_SHINGLES = 400, 400_000
#: Pairs of rows from which a column is multiplied out densely, such columns at once, and pairs added at once.
DENSE, COLUMNS, PAIRS_AT_ONCE = 640, 4096, 1_000_000


def _bins(marks: np.ndarray) -> np.ndarray:
    return (marks >> np.uint64(44)).astype(np.int64)


def prefix_length(n, percent: int):
    """So many of a set's n shingles, in any fixed order, must hold one of any set that is similar enough."""
    return n - (-(-percent * n // 100)) + 1


def _first_pass(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, key, cid, n) of each row, and for each task its counters of shingles (block, counts), in one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("shingles", object)
        counts = np.zeros(BINS, np.int32)
        names = ["doc_id", "key", "cid", "n", "block", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            cids, sizes = [], []
            for own in shingle_sets(batch.column(1), size):
                cids.append(xxhash.xxh3_64_intdigest(own.tobytes()) - 2**63)
                sizes.append(len(own))
                np.add.at(counts, _bins(own), 1)
            none = [pa.nulls(len(sizes), k) for k in kinds[4:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cids, kinds[2]), pa.array(sizes, kinds[3]), *none], names)
        if counts.any():
            parts = counts.reshape(-1, BLOCK)
            none = [pa.nulls(len(parts), k) for k in kinds[:4]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(len(parts)), kinds[4]), pa.array([p.tobytes() for p in parts], kinds[5])], names)

    return written(docs.mapInArrow(run, "doc_id long, key long, cid long, n long, block int, counts binary"), "sets")


def _sketch(passed: DataFrame) -> np.ndarray:
    """The counters of all tasks, added up block by block, 64 tasks at a time; the result has a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = np.frombuffer(counts.as_py(), np.int32)
                total[block] = total[block] + counts if block in total else counts.copy()
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([c.tobytes() for c in total.values()], pa.binary())], ["block", "counts"])

    kind = "block int, counts binary"
    parts = passed.where("block is not null").select("block", "counts")
    # Each task first adds what it reads, then a block's sums meet by its number.
    summed = parts.mapInArrow(run, kind).repartition("block").mapInArrow(run, kind)
    out = np.zeros((BINS // BLOCK, BLOCK), np.int32)
    for row in summed.toLocalIterator():
        out[row["block"]] = np.frombuffer(row["counts"], np.int32)
    return out.reshape(-1)


def _prefixes(docs: DataFrame, sketch: np.ndarray, size: int, percent: int) -> DataFrame:
    """(cid, n, marks) of each row with shingles: the prefix of its set, rare shingles first."""
    rare = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, sizes, marks = [], [], []
            for own in shingle_sets(batch.column(0), size):
                if n := len(own):
                    order = np.argsort(rare.value[_bins(own)], kind="stable")[: prefix_length(n, percent)]
                    cids.append(xxhash.xxh3_64_intdigest(own.tobytes()) - 2**63)
                    sizes.append(n)
                    marks.append(own[order].view(np.int64))
            ends = np.cumsum([0, *(len(m) for m in marks)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *marks])
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["cid", "n", "marks"])

    return docs.select("text").mapInArrow(run, "cid long, n long, marks array<long>")


def _edges(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs that may be similar, from (mark, cid, n).

    Columns of the product with up to HOT rows list their pairs, once for all columns with the same rows; counts add up,
    and pairs stay whose sizes allow the similarity and that share as many prefix shingles as it needs. The rows of a
    column above HOT are tied to the smallest of them, whatever their counts.
    """
    stats = written(rows.groupBy("mark").agg(F.count("*").alias("rows"), F.min("cid").alias("least")).where("rows > 1"), "columns")
    shared = rows.join(stats, "mark")
    hot = shared.where(F.col("rows") > HOT).select(F.col("least").alias("a"), F.col("cid").alias("b")).where("a != b").distinct()
    member = F.struct("cid", "n")
    cold = shared.where(F.col("rows") <= HOT).groupBy("mark").agg(F.array_sort(F.collect_list(member)).alias("members"))
    alike = cold.groupBy("members").agg(F.count("*").alias("columns"))
    first = alike.select("columns", "members", F.posexplode("members").alias("at", "x"))
    pairs = first.select("columns", "x", F.explode(F.expr("slice(members, at + 2, size(members))")).alias("y"))
    small, large = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    pairs = pairs.where(100 * small >= percent * large).groupBy(F.col("x.cid").alias("a"), F.col("y.cid").alias("b"), F.least("x.n", "y.n").alias("s"), F.greatest("x.n", "y.n").alias("l"))
    counted = pairs.agg(F.sum("columns").alias("common"))
    need = F.ceil(F.lit(percent) * (F.col("s") + F.col("l")) / F.lit(100.0 + percent) - 1e-9) + 1 - F.ceil(F.lit(percent) * F.col("l") / 100.0 - 1e-9)
    return counted.where(F.col("common") >= need).select("a", "b").unionByName(hot)


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """(len(a), len(b)): how many shingles each two sets share, as the product of two sparse incidence matrices.

    A column (shingle) with few pairs of rows adds 1 for each of them; those of one with many are multiplied out as dense
    columns, a few thousand at a time.
    """
    out = np.zeros(len(a) * len(b), np.int64)
    kinds, column = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    sizes = np.array([len(x) for x in (*a, *b)])
    row, cut = np.repeat(np.arange(len(sizes)), sizes), int(sizes[: len(a)].sum())
    sides = (row[:cut], column[:cut]), (row[cut:] - len(a), column[cut:])
    degree = [np.bincount(c, minlength=len(kinds)) for _, c in sides]
    pairs = degree[0] * degree[1]
    few = (pairs > 0) & (pairs <= DENSE)
    r, c = (x[few[sides[0][1]]] for x in sides[0])
    order = np.argsort(sides[1][1], kind="stable")
    other, first = sides[1][0][order], np.cumsum(degree[1]) - degree[1]
    ends = np.cumsum(degree[1][c])
    at = 0
    while at < len(c):
        last = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        many = degree[1][c[at:last]]
        within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        out += np.bincount(np.repeat(r[at:last], many) * len(b) + other[np.repeat(first[c[at:last]], many) + within], minlength=len(out))
        at = last
    dense = np.flatnonzero(pairs > DENSE)
    for i in range(0, len(dense), COLUMNS):
        place = np.full(len(kinds), -1)
        place[dense[i : i + COLUMNS]] = np.arange(len(dense[i : i + COLUMNS]))
        tables = [np.zeros((n, len(dense[i : i + COLUMNS])), np.float32) for n in (len(a), len(b))]
        for table, (r, c) in zip(tables, sides, strict=True):
            here = place[c] >= 0
            table[r[here], place[c[here]]] = 1
        out += np.rint(tables[0] @ tables[1].T).astype(np.int64).reshape(-1)
    return out.reshape(len(a), len(b))


def linked(a: list[np.ndarray], b: list[np.ndarray] | None, percent: int) -> list[tuple[int, int]]:
    """A forest of the links between the sets of a and b, by position in both together, or within a where b is None.

    The sizes give each pair the overlap that it needs; pairs with less go.
    """
    other = a if b is None else b
    n, m = np.array([len(x) for x in a])[:, None], np.array([len(x) for x in other])
    need = -(-percent * (n + m) // (100 + percent))
    close = overlaps(a, other) >= need
    i, j = np.nonzero(np.triu(close, 1) if b is None else close)
    root = roots(len(a) + (0 if b is None else len(b)), i, j if b is None else j + len(a))
    return [(int(r), k) for k, r in enumerate(root.tolist()) if r != k]


def _compared(sets: DataFrame, percent: int) -> DataFrame:
    """Forest of links (a, b) between the sets (cid, marks) of each cell (cluster, low, i, high, j): side 0 against side 1, or within side 0 where both are one block."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, low, i, high, j), rows in runs(batches, 5):
            sides = [[r for r in rows if r[0] == side] for side in (0, 1)]
            within = (low, i) == (high, j)
            if len(rows) < 2 or not (within or all(sides)):
                continue
            marks = [[np.frombuffer(r[2], np.uint64) for r in own] for own in sides]
            names = [r[1] for own in sides for r in own]
            found = linked(marks[0], None if within else marks[1], percent)
            yield pa.RecordBatch.from_pylist([{"a": names[x], "b": names[y]} for x, y in found], kind)

    cell = ["cluster", "low", "i", "high", "j"]
    cells = sets.repartition(*cell).sortWithinPartitions(*cell)
    return cells.select(*cell, "side", "cid", "marks").mapInArrow(run, "a long, b long")


def _cells(clusters: DataFrame, percent: int) -> DataFrame:
    """(cluster, cid, side, low, i, high, j): the cells in which each set of a cluster is compared.

    Sets are dealt to bands of sizes, as wide as the similarity allows two linked sets to differ, and a band's to blocks.
    Linked sets are in one band or in two next to each other, so a block meets those of its own band and of the next.
    """
    width = math.log(100 / percent) * 1.0001
    group = ["cluster", "band"]
    banded = clusters.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(width)).cast("int"))
    sizes = banded.groupBy(*group).agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    sizes = written(sizes, "bands")
    up = sizes.select("cluster", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    down = sizes.select("cluster", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    sizes = sizes.join(up, group, "left").join(down, group, "left")
    dealt = banded.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    band, block = F.col("band"), F.col("block")

    def cells(many: str, cell) -> Column:
        """One cell for each block of a band, if there are any."""
        n = F.coalesce(F.col(many), F.lit(0))
        return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.struct(*(x.cast("int").alias(name) for x, name in zip(cell(k), ("side", "low", "i", "high", "j"), strict=True))))

    own = cells("blocks", lambda k: (F.when(k < block, 1).otherwise(0), band, F.least(k, block), band, F.greatest(k, block)))
    above = cells("above", lambda k: (F.lit(0), band, block, band + 1, k))
    below = cells("below", lambda k: (F.lit(1), band - 1, k, band, block))
    return dealt.select("cluster", "cid", F.explode(F.concat(own, above, below)).alias("c")).select("cluster", "cid", "c.*")


def _picked(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(cid, marks) of the wanted (cid, doc_id): a fixed-size filter goes to all tasks, and the join that follows is exact."""
    spark = docs.sparkSession
    key = lambda cid, name: mixed(cid.astype(np.int64).view(np.uint64) ^ mixed(name.astype(np.int64).view(np.uint64))) % np.uint64(FILTER_BITS)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            out[key(batch.column(0).to_numpy(), batch.column(1).fill_null(-1).to_numpy())] = True
        packed = np.packbits(out).reshape(64, -1)
        held = [i for i in range(64) if packed[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([packed[i].tobytes() for i in held], pa.binary())], ["block", "bits"])

    packed = np.zeros((64, FILTER_BITS // 512), np.uint8)
    for row in wanted.select("cid", "doc_id").mapInArrow(bits, "block int, bits binary").toLocalIterator():
        packed[row["block"]] |= np.frombuffer(row["bits"], np.uint8)
    sent = spark.sparkContext.broadcast(packed.reshape(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), size))
            cids = np.array([xxhash.xxh3_64_intdigest(own.tobytes()) - 2**63 for own in sets], np.int64)
            at = key(cids, batch.column(0).fill_null(-1).to_numpy())
            some = np.flatnonzero(sent.value[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1)
            yield pa.RecordBatch.from_arrays([pa.array(cids[some]), batch.column(0).take(pa.array(some)), pa.array([sets[i].tobytes() for i in some], pa.binary())], ["cid", "doc_id", "marks"])

    found = docs.select("doc_id", "text").mapInArrow(run, "cid long, doc_id long, marks binary").dropDuplicates(["cid", "doc_id"])
    return found.join(wanted.select("cid", F.col("doc_id").alias("_d")), "cid").where(F.col("doc_id").eqNullSafe(F.col("_d"))).drop("_d", "doc_id")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of each row.

    Rows with the same set of shingles are one class (class_id; 64-bit fingerprints of sets and shingles stand for them).
    Two classes link when 100 x intersection >= percent x union, and component_id is the smallest id that links reach. A
    text without words (null, empty, white space) has no set and no links: its component is its own id. An id may repeat; a
    null id is no component's smallest, unless no other is there. No input: no rows.
    """
    return _judged(docs, F.lit(0), id_col, text_col, size, percent).drop("key", "component")


def _judged(docs: DataFrame, key: Column, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """The same with a key of each row and, as ids may repeat, the class that stands for its component."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), key.cast("long").alias("key"))
    passed = _first_pass(rows, size)
    each = passed.where("block is null").select("doc_id", "key", "cid", "n")
    kinds = written(each.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), "classes")
    prefixes = written(_prefixes(rows, _sketch(passed), size, percent).dropDuplicates(["cid"]), "prefixes")
    edges = written(_edges(prefixes.select("cid", "n", F.explode("marks").alias("mark")), percent), "edges")

    clusters = components(edges).withColumnsRenamed({"node": "cid", "component": "cluster"})
    clusters = written(clusters.join(kinds, "cid"), "clusters")
    links = _compared(written(_picked(rows, clusters, size), "picked").join(_cells(clusters, percent), "cid"), percent)

    groups = components(links).withColumnsRenamed({"node": "cid"})
    named = kinds.join(groups, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    final = written(named.join(least, "component").select("cid", "component_id", "component"), "components")
    full = each.where("n > 0").join(final, "cid").select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("cid").alias("class_id"), "key", "component")
    none = F.lit(None).cast("long")
    empty = each.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), none.alias("class_id"), "key", none.alias("component"))
    return full.unionByName(empty)


def keep_one(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component stays: the one with the smallest id, and of equal ids one. All columns stay.

    Documents without words link with nothing and stay, as do all without an id, as nothing names them; of equal rows one
    stays. An id may repeat: of the rows of one component that share its smallest id, one stays.
    """
    row = free(docs, "_row")
    named = docs.where("doc_id is not null").withColumn(row, F.xxhash64("doc_id", text_of()))
    judged = _judged(named, F.col(row), "doc_id", "text", size, percent)
    first = judged.where("class_id is not null and doc_id = component_id").groupBy("component").agg(F.min(F.struct("class_id", "key")).alias("first"))
    kept = first.select(F.col("first.key").alias(row)).unionByName(judged.where("class_id is null").select(F.col("key").alias(row)).distinct())
    return named.join(kept, row, "left_semi").dropDuplicates([row]).select(*docs.columns).unionByName(docs.where("doc_id is null"))
