"""Keep the n-gram profiles of samples up to date as files of documents arrive: each run takes only the files that are new.

    python -m jobs.grow_profiles --documents FOLDER --out OUT --checkpoint CHECKPOINT [--config jobs/grow_profiles.json]

Writes to OUT/counts/sample=.../ (feature, c), as Parquet. Which files were taken, and the counts so far, are in the
checkpoint of a stream that ends when it has read what is there. A batch that was cut short is taken again with the same
files and replaces what it wrote, so every document counts once. Without new files nothing is written.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from jobs.common import log
from spectrafold.streaming import counts as streaming

DEFAULT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "grow_profiles.json")


def arriving(spark: SparkSession, path: str, files_at_once: int) -> DataFrame:
    """The stream of a Parquet table's files; the table may be a single file."""
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files_at_once)
    folder, name = path.rstrip("/").rsplit("/", 1)
    files = table.inputFiles()
    if len(files) == 1 and files[0].rsplit("/", 1)[1] == name:
        return reader.option("pathGlobFilter", name).parquet(folder)  # a stream reads folders only
    return reader.parquet(path)


def grow(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict) -> dict[str, int]:
    """Count what is new, write the profiles of all samples; returns the numbers of batches and rows that were read and written.

    The profiles are the complete result of a streaming aggregate: Spark keeps its counts in the checkpoint, on disk where
    they outgrow memory, and reads no document twice. A document without text, or a sample without n-grams, adds nothing.
    """
    docs = arriving(spark, documents, config["files_at_once"])
    rows = docs.select(common.sample_of(config["sample"]).alias("_sample"), F.col(config["text"]).alias("_text"))
    counts = streaming.growing_letters(rows, "_text", "_sample", config["k"], config["pattern"])
    written = {"batches": 0, "documents read": 0, "counts written": 0}

    def write(batch: DataFrame, number: int) -> None:
        common.replace_partitions(batch.select("feature", "c", "sample"), f"{out}/counts", "sample")
        written["batches"] += 1
        log.info("batch %d: wrote the profiles of all samples to %s/counts", number, out)

    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.numRecentProgressUpdates": "100000"}
    with common.conf(spark, settings):
        query = counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        written["documents read"] = sum(p["numInputRows"] for p in query.recentProgress)
    if written["batches"]:
        written["counts written"] = spark.read.parquet(f"{out}/counts").count()
    log.info("read %d new documents from %s in %d batches; %d counts written to %s/counts", written["documents read"], documents, written["batches"], written["counts written"], out)
    return written


def main(argv: list[str] | None = None) -> None:
    common.command(grow, __doc__.splitlines()[0], ["documents", "out", "checkpoint"], DEFAULT, argv)


if __name__ == "__main__":
    main()
