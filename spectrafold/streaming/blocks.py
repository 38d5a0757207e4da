"""K-mer counts of records that arrive in blocks: the end of each record is kept between batches, so that no window is lost."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.kmers import fast_counts

#: What a block holds that came too late, or a second time: it is told apart, not dropped unseen.
LATE = "late"
#: States that records are dealt to; it must stay the same for a checkpoint.
BUCKETS = 4_096


def joined_blocks(blocks: DataFrame, k: int) -> DataFrame:
    """(sample, record, block_no, piece, status) from a stream of (sample, record, block_no, letters).

    Blocks of a record are numbered from 0 and may arrive in any order and in any batch. The state of a record is the last
    k - 1 letters of what has been joined, the number of the next block, and blocks that came before their turn. A block is
    passed on with the letters before it that windows of length k reach back to, so that over all pieces each window of a
    record comes once; its status is 'joined'. A block whose number was joined before has the status 'late' and an empty
    piece: repeated blocks count once.

    Records are dealt to BUCKETS by hash; the records of a bucket are one state, as a call for each record takes far longer
    than its work.
    """

    def join(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        samples, records, tails, turns, owners, numbers, texts = state.get if state.exists else ([],) * 7
        known = {key: [tail, turn, {}] for *key, tail, turn in zip(samples, records, tails, turns, strict=True) for key in [tuple(key)]}
        listed = list(known)
        for owner, number, text in zip(owners, numbers, texts, strict=True):
            known[listed[owner]][2][number] = text
        touched, out = {}, []
        for frame in frames:
            for sample, record, number, letters in zip(frame["sample"], frame["record"], frame["block_no"], frame["letters"], strict=True):
                key = (sample, None if pd.isna(record) else int(record))
                own = touched[key] = known.setdefault(key, ["", 0, {}])
                if number < own[1] or number in own[2]:
                    out.append((*key, int(number), "", LATE))
                else:
                    own[2][int(number)] = letters or ""
        for key, own in touched.items():
            while own[1] in own[2]:
                piece = own[0] + own[2].pop(own[1])
                out.append((*key, own[1], piece, "joined"))
                own[0], own[1] = piece[-(k - 1) :] if k > 1 else "", own[1] + 1
        waiting = [(i, n, text) for i, own in enumerate(known.values()) for n, text in own[2].items()]
        state.update(([key[0] for key in known], [key[1] for key in known], [own[0] for own in known.values()], [own[1] for own in known.values()], *([w[i] for w in waiting] for i in range(3))))
        yield pd.DataFrame(out, columns=["sample", "record", "block_no", "piece", "status"])

    state = "samples array<string>, records array<long>, tails array<string>, turns array<long>, owners array<int>, numbers array<long>, texts array<string>"
    dealt = blocks.select("sample", "record", "block_no", "letters", F.pmod(F.xxhash64("sample", "record"), F.lit(BUCKETS)).alias("bucket"))
    return dealt.groupBy("bucket").applyInPandasWithState(join, "sample string, record long, block_no long, piece string, status string", state, "append", GroupStateTimeout.NoTimeout)


def numbered_blocks(files: DataFrame, size: int) -> DataFrame:
    """(sample, record, block_no, letters) of (sample, record, sequence): blocks of `size` letters, to be sent one by one."""
    at = F.sequence(F.lit(0), F.floor((F.greatest(F.length("sequence"), F.lit(1)) - 1) / size).cast("int"))
    each = files.select("sample", "record", "sequence", F.explode(at).alias("block_no"))
    letters = F.substring(F.col("sequence"), F.col("block_no") * size + 1, F.lit(size))
    return each.select("sample", F.col("record").cast("long").alias("record"), F.col("block_no").cast("long").alias("block_no"), letters.alias("letters"))


def count_blocks(blocks: DataFrame, k: int, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Start a stream that counts the k-mers of joined blocks, each batch into a partition of its own, and ends when it has read what is there.

    A batch that is run again replaces its partition, so each k-mer counts once.
    """

    def write(batch: DataFrame, number: int) -> None:
        pieces = batch.where("status = 'joined'").select("sample", F.col("piece").alias("sequence"))
        counted = fast_counts(pieces, k, **options).withColumn("batch", F.lit(number))
        counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return joined_blocks(blocks, k).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_so_far(spark: SparkSession, out: str) -> DataFrame:
    """counts(sample, feature, c) over all batches."""
    return spark.read.parquet(out).groupBy("sample", "feature").agg(F.sum("c").alias("c"))
