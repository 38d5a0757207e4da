"""Counts of k-mers that grow as sequence files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import sequence as S
from ..operators.kmers import exploded, letter_parts
from ..sources.fasta import SUFFIXES, records


def arriving(spark: SparkSession, path: str, glob: str = SUFFIXES, files_at_once: int = 100) -> DataFrame:
    """(sample, sequence) of records as files arrive in a folder, one string a file."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_at_once).text(path, wholetext=True, pathGlobFilter=glob)
    each = rows.select(S.sample_name(F.col("_metadata.file_name")).alias("sample"), F.explode(records(F.col("value"))).alias("sequence"))
    return each.where("sequence != ''")


def growing_counts(sequences: DataFrame, k: int, validity: str = "acgt") -> DataFrame:
    """counts(sample, feature, c) so far; each batch updates the counts that it touches."""
    features = exploded(sequences, "sequence", k).where(S.valid(F.col("feature"), validity))
    return features.groupBy("sample", "feature").agg(F.count("*").alias("c"))


def growing_letters(rows: DataFrame, text: str, sample: str, k: int, pattern: str) -> DataFrame:
    """counts(sample, feature, c) so far of character n-grams, of up to three letters, that match the pattern; texts are counted in numpy before the state is touched."""
    parts = letter_parts(rows, text, sample, k).where(F.regexp_like("feature", F.lit(pattern)))
    return parts.groupBy("sample", "feature").agg(F.sum("c").alias("c"))


def windowed_counts(events: DataFrame, time: str, width: str, late: str, sample, feature) -> DataFrame:
    """counts(window, sample, feature, c) of events in windows of time; events later than `late` are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), sample.alias("sample"), feature.alias("feature")).agg(F.count("*").alias("c"))


def start(counts: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> StreamingQuery:
    """Keep the counts in a table in memory, resuming from the checkpoint."""
    return counts.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
