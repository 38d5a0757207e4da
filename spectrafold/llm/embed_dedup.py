"""Near-duplicate embeddings: exact pairs above a cosine, by dual traversal of cover trees."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, written
from .vectors import roots, runs, usable

#: Pivots of a label at the top level of the tree, vectors in a block, and pairs of vectors compared at once.
PIVOTS, BLOCK, AT_ONCE = 32, 2048, 65536


class Node:
    """Points (by position) within `radius` of the point `center`; the children's centers are farther apart than half that."""

    __slots__ = ("center", "radius", "points", "children")

    def __init__(self, center: int, radius: float, points: np.ndarray, children: list):
        self.center, self.radius, self.points, self.children = center, radius, points, children


def cover_tree(unit: np.ndarray, points: np.ndarray | None = None, center: int = 0, scale: float = 2.0, leaf: int = 64) -> Node:
    """Nested levels: each center is a center of the next level too, whose radius is half as large."""
    points = np.arange(len(unit)) if points is None else points
    own = unit[points]
    radius = float(np.sqrt(np.maximum(0.0, ((own - unit[center]) ** 2).sum(1))).max(initial=0.0))
    if len(points) <= leaf or radius < 1e-6:
        return Node(center, radius, points, [])
    while scale / 2 >= radius:
        scale /= 2
    products = own @ own.T
    within = 1 - (scale / 2) ** 2 / 2
    children, left, at = [], np.arange(len(points)), int(np.flatnonzero(points == center)[0])
    while len(left):
        near = products[at, left] >= within
        near |= left == at
        children.append((points[left[near]], int(points[at])))
        left = left[~near]
        at = int(left[0]) if len(left) else at
    del products, own
    return Node(center, radius, points, [cover_tree(unit, p, c, scale / 2, leaf) for p, c in children])


def close_pairs(a: np.ndarray, b: np.ndarray | None, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in a, positions in b) of unit vectors with at least the cosine; each pair once where b is None.

    Both trees are opened together. Of the pairs of children, those go whose centers are farther apart than both covering
    radii and the distance that the cosine stands for; the others are opened in turn, until few enough points are left to
    multiply.
    """
    far = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6
    left = cover_tree(a)
    right, other = (left, a) if b is None else (cover_tree(b), b)
    stack = [(left, right)]
    while stack:
        x, y = stack.pop()
        if len(x.points) * len(y.points) <= AT_ONCE or not (x.children or y.children):
            i, j = np.nonzero(a[x.points] @ other[y.points].T >= cosine)
            i, j = x.points[i], y.points[j]
            if x is y:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield i, j
            continue
        xs = x.children or [x]
        ys = xs if x is y else y.children or [y]
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * (a[[c.center for c in xs]] @ other[[c.center for c in ys]].T)))
        close = apart <= np.array([c.radius for c in xs])[:, None] + np.array([c.radius for c in ys]) + far
        stack += [(xs[i], ys[j]) for i, j in zip(*np.nonzero(np.triu(close) if x is y else close), strict=True)]


def _prepared(rows: DataFrame) -> DataFrame:
    """(vec_id, label, cid, unit) of each row; cid, a fingerprint of label and vector, and unit are null where it takes no part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, vectors = usable(batch.column(2))
            labels = batch.column(1).to_pylist()
            cids, units = [None] * len(batch), [None] * len(batch)
            for i, v in zip(at.tolist(), vectors, strict=True):
                if labels[i] is not None:
                    cids[i] = xxhash.xxh3_64_intdigest(f"{labels[i]}|".encode() + v.tobytes()) - 2**63
                    units[i] = (v / np.sqrt((v * v).sum())).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cids, pa.int64()), pa.array(units, pa.binary())], ["vec_id", "label", "cid", "unit"])

    return written(rows.mapInArrow(run, "vec_id long, label string, cid long, unit binary"), "units")


def _cells(kinds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors with their block, pairs of blocks that may hold links).

    The top level of the tree: up to PIVOTS vectors of each label and length, by hash, one for each BLOCK of them;
    each vector goes to the nearest, and a pivot's vectors to blocks of about BLOCK by hash. Pairs of blocks go where the pivots are too far apart.
    """
    group = ["label", "size"]
    kinds = kinds.withColumn("size", F.length("unit"))
    counts = kinds.groupBy(*group).agg(F.count("*").alias("all"))
    first = Window.partitionBy(*group).orderBy(F.xxhash64("cid"), "cid")
    lowest = F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) < F.lit(float(1 << 20) * 8 * PIVOTS) / F.col("all")
    few = kinds.join(counts, group).where((F.col("all") > BLOCK) & lowest)
    pivots = written(few.withColumn("pivot", F.row_number().over(first)).where(F.col("pivot") <= F.least(F.lit(PIVOTS), F.ceil(F.col("all") / BLOCK))).select(*group, "pivot", F.col("unit").alias("at")), "pivots")
    listed = pivots.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("pivot", "at"))).alias("pivots"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked, away, known = [], [], {}
            for label, size, unit, pivots in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist(), batch.column(5), strict=True):
                if not pivots.is_valid:
                    picked.append(0)
                    away.append(2.0)
                    continue
                if (label, size) not in known:
                    known[label, size] = np.stack([np.frombuffer(p["at"]) for p in pivots.as_py()])
                gap = np.sqrt(((known[label, size] - np.frombuffer(unit)) ** 2).sum(1))
                picked.append(int(gap.argmin()) + 1)
                away.append(float(gap.min()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(picked, pa.int32()), pa.array(away, pa.float64())], ["label", "size", "cid", "many", "unit", "pivot", "away"])

    near = kinds.join(listed, group, "left").select(*group, "cid", "many", "unit", "pivots").mapInArrow(nearest, "label string, size int, cid long, many long, unit binary, pivot int, away double")
    near = written(near, "near")
    sizes = near.groupBy(*group, "pivot").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.max("away").alias("radius"))
    placed = near.join(sizes, [*group, "pivot"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")).select(*group, "pivot", "block", "cid", "many", "unit")
    meta = sizes.join(pivots, [*group, "pivot"], "left")
    meta = written(meta, "meta")
    a, b = meta.alias("a"), meta.alias("b")
    both = a.join(b, [F.col(f"a.{g}") == F.col(f"b.{g}") for g in group]).where("a.pivot <= b.pivot")
    pair = both.select(*(F.col(f"a.{g}") for g in group), F.col("a.pivot").alias("p"), F.col("b.pivot").alias("q"), F.col("a.at").alias("x"), F.col("b.at").alias("y"), F.col("a.radius").alias("r"), F.col("b.radius").alias("s"), F.col("a.blocks").alias("m"), F.col("b.blocks").alias("n"))
    return placed, pair


def _pairs_of_blocks(pair: DataFrame, cosine: float) -> DataFrame:
    far = math.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-7

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [p["x"] is None or p["p"] == p["q"] or np.sqrt(((np.frombuffer(p["x"]) - np.frombuffer(p["y"])) ** 2).sum()) <= p["r"] + p["s"] + far for p in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(keep, pa.bool_())).select(["label", "size", "p", "q", "m", "n"]).columns, ["label", "size", "p", "q", "m", "n"])

    kept = pair.mapInArrow(run, "label string, size int, p int, q int, m int, n int")
    wide = kept.select("*", F.explode(F.expr("sequence(0, m - 1)")).alias("i")).select("*", F.explode(F.expr("sequence(if(p = q, i, 0), n - 1)")).alias("j"))
    return written(wide.select("label", "size", "p", "i", "q", "j"), "cells")


def links(kinds: DataFrame, cosine: float) -> DataFrame:
    """(a, b, many): each vector a with links in a pair of blocks, the smallest b linked to it there, directly or not, and how many rows it links with."""
    placed, pair = _cells(kinds)
    cells = _pairs_of_blocks(pair, cosine).withColumn("cell", F.monotonically_increasing_id())
    cells = written(cells, "numbered")
    sides = cells.select("cell", "label", "size", F.col("p").alias("pivot"), F.col("i").alias("block"), F.lit(0).alias("side"))
    sides = sides.unionByName(cells.where("p != q or i != j").select("cell", "label", "size", F.col("q").alias("pivot"), F.col("j").alias("block"), F.lit(1).alias("side")))
    dealt = placed.join(sides, ["label", "size", "pivot", "block"]).select("cell", "side", "cid", "many", "unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, 1):
            rows.sort(key=lambda r: r[:2])
            unit = np.stack([np.frombuffer(r[3]) for r in rows])
            many = np.array([r[2] for r in rows], np.int64)
            cut = sum(r[0] == 0 for r in rows)
            whole = cut == len(rows)
            found_i, found_j, count = [], [], np.zeros(len(rows), np.int64)
            for i, j in close_pairs(unit[:cut], None if whole else unit[cut:], cosine):
                j = j if whole else j + cut
                np.add.at(count, i, many[j])
                np.add.at(count, j, many[i])
                found_i.append(i)
                found_j.append(j)
            if not found_i:
                continue
            root = roots(len(rows), np.concatenate(found_i), np.concatenate(found_j))
            at = np.flatnonzero(count)
            cid = np.array([r[1] for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cid[at]), pa.array(cid[root[at]]), pa.array(count[at])], ["a", "b", "many"])

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long, many long")


def near_duplicates(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row.

    Rows link if their labels are equal and not null, their vectors have one length, and the cosine in double precision is
    at least the given one. Vectors that are null, empty, zero, or hold a null or a component that is not finite link with
    nothing. Equal vectors of a label are one class, compared once; n_links counts rows, copies included. component_id is
    the smallest id that links reach, kept whether that is the row's own. An id may repeat. No input: no rows.
    """
    each = _prepared(rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("embedding")))
    kinds = each.where("cid is not null").groupBy("cid", "label").agg(F.first("unit").alias("unit"), F.count("*").alias("many"), F.min("vec_id").alias("least"))
    kinds = written(kinds, "kinds")
    found = written(links(kinds.select("cid", "label", "unit", "many"), cosine), "linked")
    degree = found.groupBy("a").agg(F.sum("many").alias("links")).withColumnRenamed("a", "cid")
    groups = components(found).withColumnRenamed("node", "cid")
    named = kinds.select("cid", "many", "least").join(groups, "cid", "left").join(degree, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    final = named.join(lowest, "component").select("cid", "component_id", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"))
    final = written(final, "final")
    linked = each.where("cid is not null").select("vec_id", "cid").join(final, "cid").select("vec_id", "n_links", "component_id")
    alone = each.where("cid is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
