"""What the jobs share: their settings, their command line, and columns that name samples."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("spectrafold.jobs")


def settings(spark: SparkSession, path: str) -> dict:
    """A JSON file of settings, read by Spark, so that it can be where the tables are."""
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def sample_of(columns: list[str]) -> Column:
    """The columns' values, joined by a bar; a null is a question mark."""
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in columns))


@contextmanager
def conf(spark: SparkSession, changes: dict[str, str]) -> Iterator[None]:
    """Settings of the session for a while; what was set before is restored."""
    before = {k: spark.conf.get(k, None) for k in changes}
    for k, v in changes.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def replace_partitions(rows: DataFrame, path: str, by: str) -> None:
    """Write rows, replacing the partitions that they have and leaving others; a rerun leaves the same files' contents."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def command(run: Callable[..., dict], description: str, inputs: list[str], default: str, argv: list[str] | None = None) -> None:
    """Start a session, run the job over the given paths, and stop the session."""
    parser = argparse.ArgumentParser(description=description)
    for name in inputs:
        parser.add_argument(f"--{name}", required=True, help="path of a Parquet table" if name not in ("out", "checkpoint") else "folder")
    parser.add_argument("--config", default=default, help="JSON file of settings")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(parser.prog).getOrCreate()
    try:
        run(spark, *(getattr(args, name) for name in inputs), settings(spark, args.config))
    finally:
        spark.stop()
