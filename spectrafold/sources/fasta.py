"""Sequence files as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sequence import clean, sample_name

#: Suffixes of sequence files, plain or gzipped.
SUFFIXES = "*.{fa,fasta,fna,fas,fa.gz,fasta.gz,fna.gz,fas.gz}"

#: White space, and of ASCII: which letters are that, and all in upper case.
WHITE = re.compile(r"\s+")
BLANK = np.array([chr(i).isspace() for i in range(128)])
UPPER = np.frombuffer(bytes(range(128)).upper(), np.uint8)


def read_files(spark: SparkSession, path: str, glob: str = SUFFIXES) -> DataFrame:
    """(sample, file, text): one row a file, for sequences whose records are joined. Gzipped files are read alike; an empty file has no row."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter=glob)
    file = F.col("_metadata.file_name")
    return rows.select(sample_name(file).alias("sample"), file.alias("file"), F.col("value").alias("text"))


def read_lines(spark: SparkSession, path: str, glob: str = SUFFIXES) -> DataFrame:
    """(sample, file, record, line_no, line): sequence lines in upper case; records count from 1, lines without a header are record 0."""
    lines = read_files(spark, path, glob).select("sample", "file", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace("line", r"[\t\x0B\x0C]", " "))).where("line != ''")
    upto = Window.partitionBy("file").orderBy("line_no")
    lines = lines.withColumn("record", F.sum(F.startswith("line", F.lit(">")).cast("int")).over(upto).cast("int"))
    return lines.where(~F.startswith("line", F.lit(">"))).select("sample", "file", "record", "line_no", F.upper("line").alias("line"))


def records(text: Column) -> Column:
    """Array of the sequences of a text's records, in upper case and without white space.

    The first is what stands before the first header, so each other one is that of a record. A header is a line whose first
    visible letter is ">"; such a mark later in a line is no header.
    """
    return F.transform(F.split(text, r"(?m)^[ \t]*>[^\r\n]*"), clean)


def read_sequences(spark: SparkSession, path: str, boundary: str = "file", glob: str = SUFFIXES) -> DataFrame:
    """(sample, record, sequence): upper case, no headers, no blank lines.

    boundary "file" gives one row a file with all its records joined, "record" one row a record; what stands before the
    first header is record 0. Either way a file is one string, so it must fit a task; read_pieces() has no such limit.
    """
    rows = read_files(spark, path, glob).select("sample", records(F.col("text")).alias("all"))
    if boundary == "file":
        return rows.select("sample", F.lit(0).alias("record"), F.array_join("all", "").alias("sequence"))
    return rows.select("sample", F.posexplode("all").alias("record", "sequence")).where("sequence != ''")


def read_pieces(spark: SparkSession, path: str, k: int, boundary: str = "file", glob: str = SUFFIXES, size: int = 1_000_000) -> DataFrame:
    """(sample, sequence): pieces whose windows of k letters are those of the sequences, each once, of files of any size."""
    return read_pieces_for(spark, path, [k], boundary, glob, size).select("sample", "sequence")


def letters_of(lines: pa.Array, boundary: str) -> str:
    """The letters of lines in upper case, without white space and headers; with boundary "record", each header is an N.

    Lines of ASCII are taken together in numpy, others one by one.
    """
    wide = lines.cast(pa.large_string())
    at = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    if not len(wide) or at[-1] == at[0]:
        return ""
    data, at = np.frombuffer(wide.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]
    mark = "N" if boundary == "record" else ""
    if data.max() > 127:
        plain = (WHITE.sub("", line).upper() for line in lines.to_pylist())
        return "".join(mark if line.startswith(">") else line for line in plain)
    dark = ~BLANK[data]
    if not dark.all():
        data, at = data[dark], np.concatenate([[0], np.cumsum(dark)])[at]
    data, first, size = UPPER[data], at[:-1], np.diff(at)
    first, size = first[size > 0], size[size > 0]
    header = data[first] == ord(">")
    if header.any():
        kept = np.repeat(~header, size)
        if mark:
            data[first[header]], kept[first[header]] = ord(mark), True
        data = data[kept]
    return data.tobytes().decode("ascii")


def read_pieces_for(spark: SparkSession, path: str, ks: list[int], boundary: str = "file", glob: str = SUFFIXES, size: int = 1_000_000) -> DataFrame:
    """(sample, sequence, seen, only): pieces that hold the windows of the sequences for several lengths of window, of files of any size.

    The windows of length k that a piece stands for are those that reach beyond its first `seen` letters; a piece with `only`
    has windows of that length alone. Over all pieces, each window of each length comes once. With boundary "record", an N
    stands for each header: no k-mer holds one, so none reaches over it, and short records share a piece.

    Files are read line by line and split between tasks. A task cuts what it reads to pieces of about `size` letters that
    overlap by one less than the longest window; of each block of a file, its last letters and the first ones of the blocks
    after it make one more piece for each length. For these, files that can be split are read a second time.
    """
    most, least = max(ks), min(ks)
    rows = spark.read.text(path, pathGlobFilter=glob)
    rows = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
    names = ["file", "block", "sequence", "seen", "head", "tail"]

    def reader(edges: bool):
        """Tells the pieces of each block of a file, or its edges."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, held, letters, seen, head, out = None, [], 0, 0, "", []

            def take(text: str) -> None:
                nonlocal held, letters, seen, head
                head += text[: most - 1 - len(head)]
                held.append(text)
                letters += len(text)
                if letters < size + most:
                    return
                run, at = "".join(held), 0
                while len(run) - at >= size + most:
                    if not edges:
                        out.append((*key, run[at : at + size + most - 1], seen, None, None))
                    at, seen = at + size, most - 1
                held, letters = [run[at:]], len(run) - at

            def done() -> None:
                run = "".join(held)
                if edges:
                    out.append((*key, None, None, head, run[len(run) - min(len(run), most - 1) :]))
                elif len(run) >= least and len(run) > seen:
                    out.append((*key, run, seen, None, None))

            def told() -> pa.RecordBatch:
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()), strict=True)]
                out.clear()
                return pa.RecordBatch.from_arrays(columns, names)

            for batch in batches:
                if not len(batch):
                    continue
                files = batch.column(0).dictionary_encode()
                which, block = files.indices.to_numpy(), batch.column(1).to_numpy()
                cuts = np.flatnonzero((np.diff(which) != 0) | (np.diff(block) != 0)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)], strict=True):
                    own = files.dictionary[int(which[a])].as_py(), int(block[a])
                    if own != key:
                        if key:
                            done()
                        key, held, letters, seen, head = own, [], 0, 0, ""
                    take(letters_of(batch.column(2).slice(a, b - a), boundary))
                if out:
                    yield told()
            if key:
                done()
                if out:
                    yield told()

        return run

    schema = "file string, block long, sequence string, seen int, head string, tail string"
    inner = rows.mapInArrow(reader(False), schema).select("file", "sequence", "seen", F.lit(None).cast("int").alias("only"))
    # A gzipped file is one block, which has no seam: these files are left out before they are read.
    split = rows.where(~F.col("file").endswith(".gz")).mapInArrow(reader(True), schema)
    after = Window.partitionBy("file").orderBy("block").rowsBetween(1, most)  # a row a block of a file
    seams = split.withColumn("text", F.array_join(F.collect_list("head").over(after), ""))
    seams = seams.select("file", "tail", "text", F.explode(F.array(*map(F.lit, ks))).alias("only"))
    short = F.col("only") - 1
    seams = seams.select("file", F.concat(F.right("tail", short), F.left("text", short)).alias("sequence"), F.lit(0).alias("seen"), "only").where(F.length("sequence") >= F.col("only"))
    return inner.unionByName(seams).select(sample_name(F.url_decode("file")).alias("sample"), "sequence", "seen", "only")


def lengths(spark: SparkSession, path: str, glob: str = SUFFIXES) -> DataFrame:
    """(sample, length): letters of all sequence lines of each file, of any size; 0 for a file with headers alone."""
    rows = spark.read.text(path, pathGlobFilter=glob).select(sample_name(F.col("_metadata.file_name")).alias("sample"), F.regexp_replace("value", r"\s+", "").alias("line"))
    return rows.groupBy("sample").agg(F.sum(F.when(F.startswith("line", F.lit(">")), 0).otherwise(F.length("line"))).cast("long").alias("length"))


def headers(spark: SparkSession, path: str, glob: str = SUFFIXES) -> DataFrame:
    """(sample, header): the first header line of each file, without its mark; '' where there is none.

    Files are read line by line, and split: the header is the first of its block, in the first block that has one.
    """
    rows = spark.read.text(path, pathGlobFilter=glob)
    line = rows.select(sample_name(F.col("_metadata.file_name")).alias("sample"), F.col("_metadata.file_block_start").alias("block"), F.trim(F.col("value"), F.lit(" \t\r")).alias("line"), F.monotonically_increasing_id().alias("at"))
    marked = F.when(F.startswith("line", F.lit(">")), F.struct("block", "at", F.trim(F.substr("line", F.lit(2))).alias("header")))
    return line.groupBy("sample").agg(F.coalesce(F.min(marked)["header"], F.lit("")).alias("header"))
