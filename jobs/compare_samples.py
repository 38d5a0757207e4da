"""Compare samples of text by their n-gram profiles, by several distances at once, and say how well each distance separates the labelled groups.

    python -m jobs.compare_samples --documents DOCUMENTS --out OUT [--config jobs/compare_samples.json]

Writes to OUT, as Parquet:
    profiles                         the distinct count vectors of all n-grams, and how many n-grams have each
    pairs/run=.../                   distances of all pairs of samples
    scores/run=.../                  label, silhouette, status and nearest distance of each sample
A run replaces the profiles and the partitions of the runs in its settings; so a rerun gives the same, and one with other
settings adds to what is there.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs import common
from jobs.common import log
from spectrafold.config import PRESETS, Config
from spectrafold.functions.sequence import tag
from spectrafold.operators import counts as A
from spectrafold.operators import kmers
from spectrafold.plans import runs

DEFAULT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "compare_samples.json")


def name_of(run: dict) -> str:
    """The run as the name of a partition: its method, and whatever else it sets."""
    return "-".join([run["method"], *(f"{k}_{tag(v)}" for k, v in sorted(run.items()) if k != "method")])


def config_of(run: dict) -> Config:
    return PRESETS.get(run["method"], Config()).but(**{k: v for k, v in run.items() if k != "method"})


def labels_of(docs: DataFrame, sample: str, label: str) -> DataFrame:
    """(sample, label), checked: a sample has one label."""
    labels = docs.select(F.col(sample).alias("sample"), F.coalesce(F.col(label).cast("string"), F.lit("?")).alias("label")).distinct()
    several = labels.groupBy("sample").count().where("count > 1").count()
    if several:
        raise ValueError(f"{several} samples have more than one value of {label}")
    return labels


def compare(spark: SparkSession, documents: str, out: str, config: dict) -> dict[str, int]:
    """Read the documents, write profiles, pairs and scores; returns the numbers of rows that were read and written.

    A document without text has no n-grams; a sample without n-grams takes no part. The distances are those of Config.
    """
    read = Observation("read")
    docs = spark.read.parquet(documents).withColumn("_sample", common.sample_of(config["sample"]))
    docs = docs.select("_sample", *dict.fromkeys([config["label"], config["text"]]))
    counted = kmers.letters_counts(docs.observe(read, F.count("*").alias("rows")), config["text"], "_sample", config["k"], config["pattern"])
    A.profiles(counted).write.mode("overwrite").parquet(f"{out}/profiles")
    rows = {"documents read": read.get["rows"]}
    profiles = spark.read.parquet(f"{out}/profiles")
    counts = A.from_profiles(profiles)
    labels = labels_of(docs, "_sample", config["label"]).join(counts.select("sample").distinct(), "sample", "left_semi").persist()
    rows |= {"profiles written": profiles.count(), "samples": labels.count()}
    log.info("read %d documents from %s; wrote %d profiles of %d samples to %s/profiles", rows["documents read"], documents, rows["profiles written"], rows["samples"], out)
    try:
        for run in config["runs"]:
            name, settings = name_of(run), config_of(run)
            pairs = runs.pairs(counts, run["method"], settings).withColumn("run", F.lit(name))
            common.replace_partitions(pairs, f"{out}/pairs", "run")
            pairs = spark.read.parquet(f"{out}/pairs").where(F.col("run") == name).drop("run")
            near = pairs.select(F.explode(F.array("sample_i", "sample_j")).alias("sample"), "d").groupBy("sample").agg(F.min("d").alias("nearest"))
            scores = runs.scored(pairs, labels, settings).join(near, "sample", "left").withColumn("run", F.lit(name))
            common.replace_partitions(scores, f"{out}/scores", "run")
            rows |= {f"pairs written, {name}": pairs.count(), f"scores written, {name}": spark.read.parquet(f"{out}/scores").where(F.col("run") == name).count()}
            log.info("wrote %d pairs and %d scores of %s to %s", rows[f"pairs written, {name}"], rows[f"scores written, {name}"], name, out)
    finally:
        labels.unpersist()
    return rows


def main(argv: list[str] | None = None) -> None:
    common.command(compare, __doc__.splitlines()[0], ["documents", "out"], DEFAULT, argv)


if __name__ == "__main__":
    main()
