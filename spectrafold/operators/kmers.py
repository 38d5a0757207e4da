"""From sequences and texts to counts(sample, feature, c)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions import sequence as S
from ..sources import fasta
from . import superkmers
from .superkmers import CODE, codes, spelled

#: Windows that are counted at once in numpy, and pieces whose counts are passed on together.
PIECE, TOGETHER = 1_000_000, 64


def exploded(rows: DataFrame, sequence: str, k: int, *, size: int = 256) -> DataFrame:
    """The rows with a column `feature` for every substring of length k, by way of short overlapping blocks."""
    cut = rows.withColumn("_block", F.explode(S.blocks(F.col(sequence), k, size)))
    return cut.withColumn("feature", F.explode(S.windows(F.col("_block.block"), k))).drop("_block")


def line_blocks(lines: DataFrame, k: int) -> DataFrame:
    """Lines (sample, record, line_no, line) with the first k - 1 letters of what follows in their record.

    Lines that follow may be shorter than k - 1 letters: as many are looked at as that takes in the worst case.
    """
    if k == 1:
        return lines.withColumn("block", F.col("line"))
    ahead = Window.partitionBy("sample", "record").orderBy("line_no")
    following = F.array_join(F.collect_list("line").over(ahead.rowsBetween(1, k - 1)), "")
    return lines.withColumn("block", F.concat("line", F.substring(following, 1, k - 1)))


def native_counts(sequences: DataFrame, k: int, *, sequence: str = "sequence", validity: str = "acgt", canonical: bool = False, size: int = 256) -> DataFrame:
    """counts(sample, feature, c) with built-in functions alone; partial counts are combined before the shuffle."""
    features = exploded(sequences, sequence, k, size=size).where(S.valid(F.col("feature"), validity))
    feature = S.canonical(F.col("feature")) if canonical else F.col("feature")
    return features.groupBy("sample", feature.alias("feature")).agg(F.count("*").alias("c"))


def spread(rows: DataFrame) -> DataFrame:
    """The rows, dealt out anew only where few partitions hold any: a file with one row group is read by one task, however it is split.

    A table of many files is left as it is. For one of few files, the partitions that hold rows are counted, for which no
    column is read.
    """
    wanted = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows.isStreaming or len(rows.inputFiles()) >= wanted:
        return rows
    held = rows.select(F.spark_partition_id().alias("_at")).distinct().count()
    return rows if held >= wanted else rows.repartition(wanted)


def letter_parts(rows: DataFrame, text: str, sample: str, k: int) -> DataFrame:
    """(sample, feature, c): character n-grams of up to three letters, counted in numpy for about PIECE letters at a time.

    A feature is one integer, 21 bits a code point, so that nothing is made for each letter of a text but that. Counts are
    partial: a feature comes once a piece. Rows of a stream are counted alike.
    """

    def counted(sample, codes: list[np.ndarray]) -> pa.RecordBatch:
        kinds, counts = np.unique(np.concatenate(codes), return_counts=True)
        points = ((kinds[:, None] >> (21 * np.arange(k - 1, -1, -1))) & 0x1FFFFF).astype("<u4")
        letters = points.tobytes().decode("utf-32-le")
        features = [letters[i : i + k] for i in range(0, len(letters), k)]
        return pa.RecordBatch.from_arrays([pa.array([sample] * len(kinds), pa.string()), pa.array(features, pa.string()), pa.array(counts, pa.int64())], ["sample", "feature", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        size = 0
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                points = np.frombuffer((value.as_py() or "").encode("utf-32-le"), "<u4").astype(np.int64)
                if len(points) < k:
                    continue
                codes = points[: len(points) - k + 1].copy()
                for i in range(1, k):
                    codes = (codes << 21) | points[i : len(points) - k + 1 + i]
                held.setdefault(name, []).append(codes)
                size += len(codes)
                if size >= PIECE:
                    yield from (counted(*item) for item in held.items())
                    held, size = {}, 0
        yield from (counted(*item) for item in held.items())

    return rows.select(F.col(sample).cast("string").alias("sample"), F.col(text).alias("_text")).mapInArrow(run, "sample string, feature string, c long")


def letters_counts(rows: DataFrame, text: str, sample: str, k: int, pattern: str) -> DataFrame:
    """counts(sample, feature, c) of character n-grams of texts that match the pattern."""
    if k <= 3:
        parts = letter_parts(spread(rows.select(F.col(sample).alias("sample"), F.col(text).alias("_text"))), "_text", "sample", k)
        return parts.where(F.regexp_like("feature", F.lit(pattern))).groupBy("sample", "feature").agg(F.sum("c").alias("c"))
    grams = exploded(spread(rows.select(F.col(sample).alias("sample"), F.col(text).alias("_text"))), "_text", k)
    return grams.where(F.regexp_like("feature", F.lit(pattern))).groupBy("sample", "feature").agg(F.count("*").alias("c"))


def window_counts(data: bytes, k: int, validity: str, canonical: bool) -> tuple[np.ndarray, np.ndarray]:
    """(k-mers as bytes, counts) of one piece of sequence in upper case.

    Windows are valid where a running sum of invalid letters stands still. K-mers of A, C, G, T up to length 31 are counted
    as integers, others as byte strings.
    """
    letters = np.frombuffer(data, np.uint8)
    n = len(letters) - k + 1
    none = np.zeros(0, f"S{k}"), np.zeros(0, np.int64)
    if n < 1:
        return none
    digits = CODE[letters]
    bad = np.concatenate([[0], np.cumsum(digits > 3 if validity == "acgt" else letters == ord("N"))])
    good = bad[k:] == bad[:-k]
    if not good.any():
        return none
    if k <= 31 and validity == "acgt":
        found = codes(np.minimum(digits, 3).astype(np.int64), k)[good]
        if canonical:
            back = codes(3 - np.minimum(digits[::-1], 3).astype(np.int64), k)[::-1][good]
            found = np.minimum(found, back)
        kinds, counts = np.unique(found, return_counts=True)
        return spelled(kinds, k), counts
    table = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(letters, k)[good]).view(f"S{k}")[:, 0]
    if canonical:
        other = np.arange(256, dtype=np.uint8)
        other[np.frombuffer(b"ACGT", np.uint8)] = np.frombuffer(b"TGCA", np.uint8)
        flipped = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(other[letters], k)[good][:, ::-1]).view(f"S{k}")[:, 0]
        table = np.where(table <= flipped, table, flipped)
    return np.unique(table, return_counts=True)


def pieces_of(row: tuple, ks: list[int]) -> Iterator[tuple[int, bytes]]:
    """(k, piece) of a row (sample, sequence, seen, only) for each k, in pieces that overlap by k - 1 letters.

    Letters beyond ASCII become '?', which no k-mer of bases holds.
    """
    _, sequence, seen, only = row
    data = (sequence.as_py() or "").encode("ascii", "replace")
    for k in ks:
        if only is None or only == k:
            for at in range(max(0, seen - k + 1), max(1, len(data) - k + 1), PIECE):
                yield k, data[at : at + PIECE + k - 1]


def joined(samples: pa.Array, sequences: pa.Array) -> Iterator[tuple[str | None, bytes]]:
    """(sample, sequences joined by N) for each sample, without a Python object a sequence; a letter beyond ASCII is a '?'."""
    coded = samples.dictionary_encode("encode")
    codes = coded.indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    ends = np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), sequences.take(pa.array(order)))
    for sample, text in zip(coded.dictionary.to_pylist(), pc.binary_join(lists, "N").to_pylist(), strict=True):
        yield sample, text.encode("ascii", "replace")


def pieces(batches: Iterator[pa.RecordBatch], ks: list[int]) -> Iterator[tuple[str | None, int, bytes]]:
    """(sample, k, piece) of rows (sample, sequence, seen, only): short sequences of a sample are joined to pieces of up to PIECE letters.

    What joins them is an N, which no k-mer holds, so that no window reaches from one sequence into another.
    """
    held: dict[str | None, list[bytes]] = {}
    size = 0

    def told() -> Iterator[tuple[str | None, int, bytes]]:
        for sample, parts in held.items():
            data = b"N".join(parts)
            yield from ((sample, k, data) for k in ks)

    for batch in batches:
        sequences = pc.fill_null(batch.column(1), "")
        letters = pc.utf8_length(sequences).to_numpy().astype(np.int64)
        alone = (batch.column(2).to_numpy() != 0) | batch.column(3).is_valid().to_numpy(zero_copy_only=False) | (letters > PIECE)
        for at in np.flatnonzero(alone).tolist():
            row = batch.column(0)[at].as_py(), sequences[at], batch.column(2)[at].as_py(), batch.column(3)[at].as_py()
            yield from ((row[0], k, piece) for k, piece in pieces_of(row, ks))
        short = np.flatnonzero(~alone)
        ends = np.cumsum(letters[short] + 1)
        start = 0
        while start < len(short):
            # As many as fill the piece, and the one that overfills it.
            base = int(ends[start - 1]) if start else 0
            end = min(len(short), int(np.searchsorted(ends, base + PIECE - size)) + 1)
            own = pa.array(short[start:end])
            for sample, data in joined(batch.column(0).take(own), sequences.take(own)):
                held.setdefault(sample, []).append(data)
            size, start = size + int(ends[end - 1]) - base, end
            if size >= PIECE:
                yield from told()
                held, size = {}, 0
    yield from told()


def fast_counts(sequences: DataFrame, k: int, *, validity: str = "acgt", canonical: bool = False) -> DataFrame:
    """counts(sample, feature, c) from (sample, sequence): counted piece by piece in numpy, then added up by Spark."""
    return grid_counts(sequences, [k], validity=validity, canonical=canonical).select("sample", "feature", "c")


def grid_counts(sequences: DataFrame, ks: list[int], *, validity: str = "acgt", canonical: bool = False) -> DataFrame:
    """counts(k, sample, feature, c) of all lengths in one scan of (sample, sequence[, seen, only]), as read_pieces_for gives it.

    K-mers of PACKED to 31 bases are shuffled as super-k-mers; shorter ones, of which there are few kinds, and others as
    partial counts.
    """
    if "seen" not in sequences.columns:
        sequences = sequences.select("sample", "sequence", F.lit(0).alias("seen"), F.lit(None).cast("int").alias("only"))
    rows = sequences.select(F.col("sample").cast("string").alias("sample"), "sequence", "seen", "only")
    packed = [k for k in ks if validity == "acgt" and superkmers.PACKED <= k <= 31]
    plain = [k for k in ks if k not in packed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for sample, k, piece in pieces(batches, plain):
            kinds, counts = window_counts(piece, k, validity, canonical)
            if len(kinds):
                held.append(pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), k, np.int32)), pa.array([sample] * len(kinds), pa.string()), pa.array(kinds.astype(str), pa.string()), pa.array(counts, pa.int64())], ["k", "sample", "feature", "c"]))
            if len(held) >= TOGETHER:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held = []
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    out = superkmers.counts(rows, packed, canonical) if packed else None
    if plain:
        parts = rows.mapInArrow(run, "k int, sample string, feature string, c long").groupBy("k", "sample", "feature").agg(F.sum("c").alias("c"))
        out = parts if out is None else out.unionByName(parts)
    return out


def fasta_counts(spark: SparkSession, path: str, config: Config, glob: str = fasta.SUFFIXES) -> DataFrame:
    """counts(sample, feature, c) of the k-mers of all sequence files at a path, which may be of any size."""
    return fasta_grid_counts(spark, path, [config.k], config, glob).select("sample", "feature", "c")


def fasta_grid_counts(spark: SparkSession, path: str, ks: list[int], config: Config, glob: str = fasta.SUFFIXES) -> DataFrame:
    """counts(k, sample, feature, c) for several k in one scan of the files; what else matters is in the configuration."""
    sequences = fasta.read_pieces_for(spark, path, ks, config.boundary, glob)
    return grid_counts(sequences, ks, validity=config.validity, canonical=config.canonical)


def lengths(sequences: DataFrame) -> DataFrame:
    """(sample, length): bases of each sample."""
    return sequences.groupBy("sample").agg(F.sum(F.length("sequence")).cast("long").alias("length"))


def column_counts(rows: DataFrame, sample, feature) -> DataFrame:
    """counts(sample, feature, c) of the values of a column or expression."""
    return rows.groupBy(sample.alias("sample"), feature.alias("feature")).agg(F.count("*").alias("c"))
