"""Helpers that the operators share: the shared folder, tables written to it, row keys and components."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as a word everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


#: Rows of one Arrow batch: few, as texts may be long.
BATCH_ROWS = 500


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose rows reach Python in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Where that is unset, a temporary folder serves in local mode only; on a cluster its executors would write to disks of
    their own, so there is an error instead.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="spectrafold-")
        sc.setCheckpointDir(named)
    return named


#: Tables that written() made and nobody has dropped, oldest first.
TABLES: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends there, and lost executors cost nothing.

    The table stays until it is dropped, by drop() or by drop_since().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    TABLES.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Remove tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in TABLES:
            TABLES.remove(path)


def drop_since(spark: SparkSession, first: int, keep: int = 0) -> None:
    """Remove all tables made since there were `first` of them, but not the last `keep`."""
    drop(spark, TABLES[first : len(TABLES) - keep])


def let_go(spark: SparkSession) -> None:
    """Collect garbage here and in the driver's JVM: only then does Spark remove the shuffles and broadcasts of finished queries."""
    gc.collect()
    spark._jvm.System.gc()


_HELD: dict = {}


def held(name, make: Callable):
    """What make() gave when it was first asked for under this name in this Python worker, as long as no other name is.

    A worker outlives its tasks and serves one operator after the other, so only one thing stays in it at a time.
    """
    if name not in _HELD:
        _HELD.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _HELD[name] = make()
    return _HELD[name]


def text_of(name: str = "text") -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of the links, component being the smallest node reachable.

    Each round hangs every node's neighbours under the smallest of them (large star, then small star), so the rounds grow
    with the logarithm of the longest chain and the rows never outgrow the links. A star's rows meet in an aggregate,
    which combines before the shuffle, and in a join of two written tables, which Spark splits if it is skewed.
    """
    spark = links.sparkSession
    edges = written(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").distinct(), "links")
    last = None
    while True:
        first = len(TABLES) - 1
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large.distinct(), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        drop_since(spark, first, keep=1)
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.countDistinct("u")).first()
        # Every node but the roots has one link, and that to its root, once nothing changes.
        if now == last:
            break
        last = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def free(df: DataFrame, name: str) -> str:
    """The name, or one with more underscores before it that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
