"""Results as files: tables, matrices and what plots are drawn from."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def square(pairs: DataFrame, value: str = "d", diagonal: float = 0.0) -> DataFrame:
    """(sample_i, sample_j, value) of all ordered pairs, the diagonal included."""
    one = pairs.select("sample_i", "sample_j", value)
    names = one.select(F.col("sample_i").alias("s")).union(one.select("sample_j")).distinct()
    return one.union(one.select("sample_j", "sample_i", value)).union(names.select("s", "s", F.lit(float(diagonal))))


def wide(pairs: DataFrame, value: str = "d", diagonal: float = 0.0) -> DataFrame:
    """A row and a column for each sample, in order of names."""
    rows = square(pairs, value, diagonal)
    return rows.groupBy(F.col("sample_i").alias("sample")).pivot("sample_j").agg(F.first(value)).orderBy("sample")


def write_csv(rows: DataFrame, path: str, decimals: dict[str, str] | None = None) -> None:
    """CSV with a header; columns named in decimals by a printf format, such as %.8f or %.12e."""
    for column, form in (decimals or {}).items():
        rows = rows.withColumn(column, F.when(F.col(column).isNotNull(), F.format_string(form, F.col(column))))
    rows.write.mode("overwrite").csv(path, header=True)


def write_matrix(pairs: DataFrame, path: str, form: str = "%.8e", separator: str = " ") -> None:
    """A matrix as lines of numbers, one file, samples in order of names."""
    pairs = pairs.persist()  # the matrix reads them several times, and its columns are found first
    table = wide(pairs)
    numbers = [F.format_string(form, F.col(f"`{c}`")) for c in table.columns[1:]]
    table.coalesce(1).sortWithinPartitions("sample").select(F.concat_ws(separator, *numbers).alias("value")).write.mode("overwrite").text(path)
    pairs.unpersist()


def upsert(rows: DataFrame, path: str, key: list[str], buckets: int = 16) -> None:
    """Add rows to a table, in place of those that have their keys; a table that isn't there is made.

    The table is partitioned by a hash of the key. Only the partitions that new rows fall into are written again, by one
    dynamic overwrite: Spark puts them in place when all tasks have ended, so a run that fails leaves the table as it was.
    rows have each key once; a null is a key like others. The number of buckets of a table must stay the same.
    """
    placed = rows.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    old = _read(rows.sparkSession, path)
    if old is not None:
        touched = placed.select("_bucket").distinct()
        same = [F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}")) for c in ["_bucket", *key]]
        kept = old.join(F.broadcast(touched), "_bucket", "left_semi").alias("o").join(placed.select("_bucket", *key).alias("n"), same, "left_anti")
        placed = kept.select(*placed.columns).unionByName(placed)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(path)


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_bucket")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or none if nothing is there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def save_pairs(pairs: DataFrame, path: str) -> None:
    pairs.write.mode("overwrite").parquet(path)


def save_text(spark: SparkSession, text: str, path: str) -> None:
    """A text of one line, such as a run's parameters, as a file beside its results."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def saved_text(spark: SparkSession, path: str) -> str | None:
    try:
        rows = spark.read.text(path).take(1)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows[0]["value"] if rows else None


def load_pairs(spark: SparkSession, path: str, samples: int, square_root: bool = False) -> DataFrame:
    """Saved pairs again: their number is checked, both directions become one mean, negatives 0; d squared too, if asked for."""
    rows = spark.read.parquet(path)
    low, high = F.least("sample_i", "sample_j"), F.greatest("sample_i", "sample_j")
    half = rows.where("sample_i != sample_j").groupBy(low.alias("sample_i"), high.alias("sample_j")).agg(F.greatest(F.avg("d"), F.lit(0.0)).alias("d"))
    if (found := half.count()) != samples * (samples - 1) // 2:
        raise ValueError(f"{found} pairs are no matrix of {samples} samples")
    return half.withColumn("squared", F.col("d") * F.col("d")) if square_root else half


def manifest(spark: SparkSession, path: str, glob: str, **settings) -> DataFrame:
    """(path, length, modified, settings): a row for each input file; files are listed, not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", F.col("modificationTime").alias("modified"), F.lit(json.dumps(settings, sort_keys=True)).alias("settings"))


def digest(rows: DataFrame) -> str:
    """A short name for the rows, whatever their order."""
    row = F.xxhash64(*rows.columns)
    found = rows.agg(F.count("*"), F.coalesce(F.bit_xor(row), F.lit(0)), F.coalesce(F.sum(F.pmod(row, F.lit(2**31 - 1))), F.lit(0))).first()
    return "-".join(f"{v & (2**64 - 1):x}" for v in found)


def cached(spark: SparkSession, folder: str, inputs: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:
    """What make() gives, from the folder if it was saved there for the same manifest of inputs, and saved there otherwise.

    The folder has a subfolder for each digest of a manifest. Its manifest is written after its rows, so one that was cut
    short counts as none; all of the manifest is compared, not its digest alone.
    """
    place = f"{folder}/{digest(inputs)}"
    saved = _read(spark, f"{place}/manifest")
    if saved is None or saved.exceptAll(inputs).count() or inputs.exceptAll(saved).count():
        make().write.mode("overwrite").parquet(f"{place}/rows")
        inputs.write.mode("overwrite").parquet(f"{place}/manifest")
    return spark.read.parquet(f"{place}/rows")


def heatmap_cells(pairs: DataFrame) -> DataFrame:
    """(row, column, d): places by order of names, ready to be drawn."""
    cells = square(pairs)
    return cells.select((F.dense_rank().over(Window.orderBy("sample_i")) - 1).alias("row"), (F.dense_rank().over(Window.orderBy("sample_j")) - 1).alias("column"), "d")


def bars(scores: DataFrame) -> DataFrame:
    """(place, sample, label, silhouette) by falling silhouette."""
    return scores.select(F.row_number().over(Window.orderBy(F.col("silhouette").desc(), "sample")).alias("place"), "sample", "label", "silhouette")

