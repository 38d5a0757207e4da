"""Sums over the features that two samples share, for all pairs of samples.

Samples are dealt to blocks and features to ranges. A cell is two blocks and a range: its entries meet in one task, which
adds up the products of all its pairs in numpy, and passes on a row for each pair. A feature that all samples have is thus
split between as many tasks as there are pairs of blocks, and no row is made for each pair and feature.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples of a block, and entries that a task gathers before it adds them up.
BLOCK, ENTRIES = 1_024, 200_000
#: Features that fewer samples of a cell have are added up pair by pair, others by a matrix product of about so many numbers.
DENSE, NUMBERS = 64, 2_000_000
#: Distinct weights of features, up to which products are added up before they are weighted: sums of counts are exact until then.
WEIGHTS = 32

Fields = dict[str, np.ndarray]


def _cells(values: DataFrame, samples: DataFrame, fields: list[str], by: tuple[str, ...]) -> DataFrame:
    """The entries (cell, *by, feature, sample, block, *fields) in as many cells as their sample's block has partners, sorted in each.

    Ranges are as many as keep all tasks busy where the pairs of blocks don't.
    """
    tasks = 2 * int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = samples.agg(F.greatest(F.lit(1), F.ceil(F.count_distinct("sample") / BLOCK)).cast("int").alias("_blocks"))
    ranges = F.greatest(F.lit(1), F.ceil(F.lit(2 * tasks) / (F.col("_blocks") * (F.col("_blocks") + 1)))).cast("int").alias("_ranges")
    one = F.broadcast(blocks.select("_blocks", ranges))
    feature = F.coalesce(F.col("feature").cast("string"), F.lit("\0")).alias("feature")
    placed = values.where("sample is not null").select(*by, feature, F.col("sample").cast("string").alias("sample"), *fields).crossJoin(one)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("sample"), F.col("_blocks")).cast("int")).withColumn("_range", F.pmod(F.xxhash64("feature", F.lit(7)), F.col("_ranges")))
    dealt = placed.withColumn("_other", F.explode(F.expr("sequence(0, _blocks - 1)")))
    cell = F.concat_ws("|", *by, F.least("block", "_other"), F.greatest("block", "_other"), "_range")
    return dealt.select(cell.alias("cell"), *by, "feature", "sample", "block", *fields).repartition("cell").sortWithinPartitions("cell", "feature", "sample")


class Cell:
    """Sums of the pairs of one cell, by their places in the list of its samples."""

    def __init__(self):
        self.names: dict[str, int] = {}
        self.block: list[int] = []
        self.sums: dict[str, np.ndarray] = {}

    def places(self, names: pa.Array, blocks: np.ndarray) -> np.ndarray:
        """The place of each entry's sample."""
        coded = names.dictionary_encode()
        codes = coded.indices.to_numpy()
        first = np.full(len(coded.dictionary), -1)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        own = np.empty(len(first), np.int64)
        for i, name in enumerate(coded.dictionary.to_pylist()):
            if name not in self.names:
                self.names[name] = len(self.names)
                self.block.append(int(blocks[first[i]]))
            own[i] = self.names[name]
        return own[codes]

    def room(self, term: str) -> np.ndarray:
        """The table of a term, with a row and a column for each sample at least."""
        n, old = len(self.names), self.sums.get(term)
        if old is None or len(old) < n:
            new = np.zeros((max(n, len(old) * 5 // 4 if old is not None else 0),) * 2)
            if old is not None:
                new[: len(old), : len(old)] = old
            self.sums[term] = new
        return self.sums[term]

    def add(self, term: str, i: np.ndarray, j: np.ndarray, values: np.ndarray) -> None:
        room = self.room(term)
        if len(i) * 8 < room.size:
            np.add.at(room, (i, j), values)
        else:
            room += np.bincount(i * len(room) + j, values, room.size).reshape(room.shape)

    def weighted(self, term: str, features: np.ndarray, places: np.ndarray, left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> None:
        """Add the products left x right x weight, which is the same for all entries of a feature."""
        kinds = np.unique(weight)
        if len(kinds) > WEIGHTS:
            return self.multiply(term, features, places, left * weight, right)
        for kind in kinds:
            own = weight == kind
            self.multiply(term, features[own], places[own], left[own], right[own], float(kind))

    def multiply(self, term: str, features: np.ndarray, places: np.ndarray, left: np.ndarray, right: np.ndarray, scale: float = 1.0) -> None:
        """Add the products left x right, times the scale, of all ordered pairs of entries that share a feature; features come in order."""
        count = np.bincount(features)
        wide = count[features] >= DENSE if len(self.names) > DENSE else count[features] > 1
        if wide.any():
            room, n = self.room(term), len(self.names)
            _, at = np.unique(features[wide], return_inverse=True)
            where, a, b = places[wide], left[wide], right[wide]
            step = max(1, NUMBERS // n)
            for start in range(0, int(at[-1]) + 1, step):
                low, high = np.searchsorted(at, [start, start + step])
                one, two = np.zeros((step, n)), np.zeros((step, n))
                one[at[low:high] - start, where[low:high]] = a[low:high]
                two[at[low:high] - start, where[low:high]] = b[low:high]
                room[:n, :n] += scale * (one.T @ two)
        for i, j in _pairs(np.where(wide | (count[features] < 2), -1, features)):
            self.add(term, places[i], places[j], left[i] * right[j] * scale)
            self.add(term, places[j], places[i], left[j] * right[i] * scale)

    def rows(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(names in order, places in it, pairs of places i < j that the cell is for)."""
        names = sorted(self.names, key=str.encode)
        order = np.array([self.names[n] for n in names], np.int64)
        block = np.array(self.block, np.int64)[order]
        wanted = np.triu(np.ones((len(names),) * 2, bool), 1)
        if len(set(self.block)) > 1:
            wanted &= block[:, None] != block
        return names, order, wanted


def _pairs(features: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i before j, of entries with one feature, an array for each distance between them; -1 is none."""
    lag = 1
    while lag < len(features):
        i = np.flatnonzero((features[lag:] == features[:-lag]) & (features[lag:] >= 0))
        if not len(i):
            return
        yield i, i + lag
        lag += 1


def _sums(values: DataFrame, samples: DataFrame, fields: list[str], by: tuple[str, ...], add: Callable[[Cell, np.ndarray, np.ndarray, dict[str, pa.Array]], None], out: Callable[[Cell, str], np.ndarray], terms: list[str], more: str = "") -> DataFrame:
    """(*by, [more,] i, j, *terms): `add` puts a chunk of entries into a cell, `out` gives the table of a term."""
    kinds = {c: k for c, k in values.dtypes}
    head = "".join(f"`{c}` {kinds[c]}, " for c in by)
    names = [*by, *([more] if more else []), "i", "j", *terms]

    def result(cell: Cell, key: tuple) -> Iterator[pa.RecordBatch]:
        listed, order, wanted = cell.rows()
        parts = sorted({t.rpartition("|")[0] for t in cell.sums}) if more else [""]
        for part in parts:
            tables = [out(cell, f"{part}|{t}" if more else t)[np.ix_(order, order)] if order.size else np.zeros((0, 0)) for t in terms]
            i, j = np.nonzero(wanted & np.logical_or.reduce([t != 0 for t in tables]))
            if len(i):
                text = pa.array(listed, pa.string())
                own = [pa.repeat(k, len(i)) for k in key] + ([pa.array(np.full(len(i), int(part), np.int32))] if more else [])
                yield pa.RecordBatch.from_arrays([*own, text.take(pa.array(i)), text.take(pa.array(j)), *(pa.array(t[i, j]) for t in tables)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, cell, held = None, (), Cell(), None

        def take(chunk: pa.RecordBatch, last: bool) -> pa.RecordBatch | None:
            """Add up the chunk but for the entries of its last feature, which may go on; these are returned."""
            codes = chunk.column("feature").dictionary_encode().indices.to_numpy()
            end = len(codes) if last else int(np.searchsorted(codes, codes[-1]))
            if end:
                whole = chunk.slice(0, end)
                places = cell.places(whole.column("sample"), whole.column("block").to_numpy())
                add(cell, codes[:end], places, {f: whole.column(f) for f in (*by, *fields)})
            return None if last else chunk.slice(end)

        def joined(a: pa.RecordBatch | None, b: pa.RecordBatch) -> pa.RecordBatch:
            return b if a is None else pa.Table.from_batches([a, b]).combine_chunks().to_batches()[0]

        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            cells = batch.column("cell").dictionary_encode()
            codes = cells.indices.to_numpy()
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                name = cells.dictionary[int(codes[a])].as_py()
                if name != now:
                    if waiting:
                        held = joined(held, pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])
                    if held is not None:
                        take(held, True)
                    yield from result(cell, key)
                    now, cell, held, waiting = name, Cell(), None, []
                    key = tuple(batch.column(c)[a] for c in by)
                waiting.append(batch.slice(a, b - a))
                if sum(map(len, waiting)) >= ENTRIES:
                    held = take(joined(held, pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]), False)
                    waiting = []
        if waiting:
            held = joined(held, pa.Table.from_batches(waiting).combine_chunks().to_batches()[0])
        if held is not None:
            take(held, True)
        yield from result(cell, key)

    schema = f"{head}{f'{more} int, ' if more else ''}i string, j string, {', '.join(f'{t} double' for t in terms)}"
    parts = _cells(values, samples, fields, by).mapInArrow(run, schema)
    return parts.groupBy(*names[: -len(terms)]).agg(*(F.sum(t).alias(t) for t in terms))


def product_sums(values: DataFrame, samples: DataFrame, left: str, right: str, by: tuple[str, ...] = (), weight: str | None = None) -> DataFrame:
    """(*by, i, j, ij, ji) for i < j: sums of left of i times right of j, and of right of i times left of j, times the feature's weight if one is named.

    values: (*by, feature, sample, left, right[, weight]), one row for a sample and feature. samples: any rows whose `sample` is each of
    theirs; they are only counted.
    """

    def add(cell: Cell, features: np.ndarray, places: np.ndarray, own: dict[str, pa.Array]) -> None:
        if weight:
            cell.weighted("s", features, places, own[left].to_numpy(), own[right].to_numpy(), own[weight].to_numpy())
        else:
            cell.multiply("s", features, places, own[left].to_numpy(), own[right].to_numpy())

    return _sums(values, samples, list(dict.fromkeys([left, right] + ([weight] if weight else []))), by, add, lambda cell, t: cell.room("s") if t == "ij" else cell.room("s").T, ["ij", "ji"])


def pair_sums(values: DataFrame, samples: DataFrame, fields: list[str], terms: Callable[[Fields, Fields], Fields], names: list[str]) -> DataFrame:
    """(i, j, *names) for i < j: sums of what `terms` gives for the fields of both samples, of any form."""

    def add(cell: Cell, features: np.ndarray, places: np.ndarray, own: dict[str, pa.Array]) -> None:
        table = {f: v.to_numpy() for f, v in own.items()}
        for i, j in _pairs(features):
            for name, value in terms({f: v[i] for f, v in table.items()}, {f: v[j] for f, v in table.items()}).items():
                cell.add(name, places[i], places[j], value)

    return _sums(values, samples, fields, (), add, Cell.room, names)


def grid_sums(values: DataFrame, samples: DataFrame, fields: list[str], factors: Callable[[dict[str, np.ndarray]], dict[int, tuple[np.ndarray, np.ndarray]]], by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, g, i, j, ij, ji) like product_sums, for each g that `factors` gives left and right of; entries are shuffled once for all of them.

    A field may hold an array an entry, all of one length. `factors` is given the columns of `by`, too, one value a call.
    """

    def add(cell: Cell, features: np.ndarray, places: np.ndarray, own: dict[str, pa.Array]) -> None:
        table = {f: v.flatten().to_numpy().reshape(len(v), -1) if pa.types.is_list(v.type) else v.to_numpy() for f, v in own.items()}
        for g, (left, right) in factors(table).items():
            cell.multiply(f"{g}|ij", features, places, left, right)

    def out(cell: Cell, name: str) -> np.ndarray:
        part, _, t = name.rpartition("|")
        return cell.room(f"{part}|ij") if t == "ij" else cell.room(f"{part}|ij").T

    return _sums(values, samples, fields, by, add, out, ["ij", "ji"], more="g")
