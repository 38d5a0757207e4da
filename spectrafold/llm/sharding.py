"""Sharding by a two-pass external shuffle: records are scattered into memory-sized buckets, each of which is then shuffled and written."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import TABLES, free, shared_dir, written

#: Bytes of a bucket, which one task holds at a time, and buckets to a shuffle partition at least, so that small tables are dealt out too.
BUCKET_BYTES, BUCKETS = 32_000_000, 4
#: A bucket is dealt on where it holds more than this many times its bytes, which only copies of one row bring about.
CROWDED = 4
#: Buckets that share one running total; the totals of these groups are added up in turn.
GROUP = 1024
#: Crowded buckets that are broadcast; with more of them, rows are joined by shuffle.
FEW = 100_000


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A permutation of n places: from the last place down, each is swapped with one drawn from those not above it."""
    order = list(range(n))
    draws = rng.integers(0, np.arange(1, n + 1)).tolist()
    for i in range(n - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    return np.array(order, np.int64)


def bytes_of(text: Column) -> Column:
    """Size of a record: the UTF-8 bytes of its text, none if it is null, and 8."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def _keys(docs: DataFrame, seed: str) -> tuple[Column, Column]:
    """Two seeded hashes of all that a row holds: the first picks its bucket, both its place before the shuffle."""
    own = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    return F.xxhash64(F.lit(seed), *own), F.xxhash64(F.lit(f"{seed}-2"), *(c.isNull() for c in own), *own)


def _starts(sizes: DataFrame) -> DataFrame:
    """(bucket, part, start, rows): how many rows the buckets before each one hold, added up by groups of buckets and within them."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    grouped = sizes.withColumn("group", F.expr(f"bucket div {GROUP}"))
    within = F.sum("rows").over(before(Window.partitionBy("group").orderBy("bucket", "part")))
    groups = grouped.groupBy("group").agg(F.sum("rows").alias("all")).withColumn("ahead", F.sum("all").over(before(Window.orderBy("group"))))
    start = F.coalesce("within", F.lit(0)) + F.coalesce("ahead", F.lit(0))
    return grouped.withColumn("within", within).join(groups.select("group", "ahead"), "group").select("bucket", "part", start.alias("start"), "rows")


def shuffled(docs: DataFrame, *, text_col: str = "text", seed: str = "shards-1", bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, str, int]:
    """(rows, name, count): docs with the place of each row in one uniform order of all of them, from 0, in a column of that name.

    First pass: a seeded hash of its content puts each row into one of as many buckets as hold bucket_bytes each. Second
    pass: a bucket's rows, sorted by that hash so that reruns agree, are shuffled by Fisher and Yates, the generator being
    seeded by the bucket; its places begin after those of the buckets before it. Equal rows have one hash; where copies of
    a row crowd a bucket, it is dealt on into parts by where its rows stand in the input, so that what a part holds of it
    can differ between reruns over other files. No bucket passes through the driver.
    """
    spark = docs.sparkSession
    columns = docs.columns
    first, second = _keys(docs, seed)
    text = F.col(f"`{text_col}`")
    keyed = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)), first.alias("first"), second.alias("second"), bytes_of(text).alias("bytes"))
    count, total = docs.agg(F.count("*"), F.sum(bytes_of(text))).first()
    buckets = max(1, math.ceil((total or 0) / bucket_bytes), min(count, BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    keyed = keyed.withColumn("bucket", F.pmod("first", F.lit(buckets))).withColumn("part", F.lit(0).cast("long"))
    group = ["bucket", "part"]
    sizes = written(keyed.groupBy(*group).agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")), "buckets")
    crowded = sizes.where((F.col("bytes") > CROWDED * bucket_bytes) & (F.col("rows") > 1)).select("bucket", F.ceil(F.col("bytes") / bucket_bytes).alias("parts"))
    if many := crowded.count():
        dealt = keyed.join(F.broadcast(crowded) if many <= FEW else crowded, "bucket", "left")
        part = F.pmod(F.xxhash64("first", F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1)))
        keyed = written(dealt.withColumn("part", part).drop("parts"), "dealt")  # where rows stand must not change between the two passes
        sizes = written(keyed.groupBy(*group).agg(F.count("*").alias("rows")), "parts")
    starts = _starts(sizes)

    def shuffle(key: tuple, rows: pa.Table, start: pa.Table) -> pa.Table:
        if start.num_rows != 1 or start["rows"][0].as_py() != rows.num_rows:
            raise RuntimeError("the input changed between the two passes")
        bucket, part = (k.as_py() for k in key)
        order = np.lexsort((rows["second"].to_numpy(), rows["first"].to_numpy()))
        order = order[fisher_yates(len(order), np.random.default_rng([*seed.encode(), bucket, part]))]
        places = np.arange(len(order)) + start["start"][0].as_py()
        taken = rows.take(pa.array(order))
        return pa.table([*(taken[f"c{i}"] for i in range(len(columns))), pa.array(places)], [*(f"c{i}" for i in range(len(columns))), "place"])

    schema = T.StructType([*(T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)), T.StructField("place", T.LongType())])
    out = keyed.drop("bytes").groupBy(*group).cogroup(starts.groupBy(*group)).applyInArrow(shuffle, schema)
    place = free(docs, "place")
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(columns)), F.col("place").alias(place)), place, count


def placed(docs: DataFrame, *, shards: int = 24, **options) -> tuple[DataFrame, str, str]:
    """(rows, shard, slot): docs with two more columns of these names.

    The shuffled order is cut into shards whose numbers of rows are at most one apart; slots count from 0 in each shard.
    """
    rows, place, count = shuffled(docs, **options)
    small, more = divmod(count, shards)
    at, border = F.col(place), more * (small + 1)
    early, late = F.floor(at / (small + 1)), F.floor((at - border) / max(1, small))
    shard, slot = free(docs, "shard"), free(docs, "slot")
    number = F.when(at < border, early).otherwise(late + more).cast("int")
    first = F.when(F.col(shard) <= more, F.col(shard).cast("long") * (small + 1)).otherwise(border + (F.col(shard).cast("long") - more) * small)
    return rows.withColumn(shard, number).withColumn(slot, at - first).drop(place), shard, slot


def write_shards(docs: DataFrame, path: str, **options) -> tuple[DataFrame, str, str]:
    """Write the shuffled rows to path, one folder a shard and rows by slot in each file, and read them back: (rows, shard, slot)."""
    rows, shard, slot = placed(docs, **options)
    rows.sortWithinPartitions(shard, slot).write.partitionBy(shard).option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(rows.schema).parquet(path), shard, slot


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 24, **options) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of each row, from the files that write_shards made in the shared folder.

    The law is `rows`: the shards' numbers of rows are at most one apart, so grown_shard is null. Null text: size 8, and the
    checksum of no bytes, 0. Equal rows, and rows that share an id or have none, are rows of their own, each in a slot; equal
    texts are not kept together. Other columns, whatever their names, are written with the rows and left out here. Fewer rows
    than shards: one each in the first ones. No input: no rows.
    """
    path = f"{shared_dir(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    TABLES.append(path)
    rows, shard, slot = write_shards(docs, path, text_col=text_col, shards=shards, **options)
    text = F.col(f"`{text_col}`")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    return rows.select(F.col(f"`{id_col}`").alias("doc_id"), bytes_of(text).alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), F.col(shard).alias("shard"), F.col(slot).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
