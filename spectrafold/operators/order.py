"""Places in an order of all rows, and exact quantiles, without ever bringing all rows to one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.shared import written

#: Rows of a range, ranges at most, and bins of one pass over the values.
RANGE, RANGES, BINS = 100_000, 4_096, 1_024


def ranked(rows: DataFrame, keys: list[Column], name: str = "place", size: int = RANGE) -> DataFrame:
    """The rows with their place, from 1, in the order of the keys; rows with equal keys follow in any order.

    Spark deals the rows to ranges of the keys, which are written once, so that a row stays in its range. A row's place is
    its place in its range, plus the rows of the ranges before it. Nulls come first. A row for each range is what reaches the
    driver. Ranges of fewer than RANGE rows are made only as far as they keep tasks busy.
    """
    keyed = rows.withColumn("_key", F.struct(*(k.alias(f"k{i}") for i, k in enumerate(keys))))
    total = rows.count()
    tasks = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = min(RANGES, max(1, math.ceil(total / size)), max(tasks, math.ceil(total / RANGE)))
    if ranges > 1:
        keyed = written(keyed.repartitionByRange(ranges, "_key").withColumn("_range", F.spark_partition_id()), "ranges")
    else:
        keyed = keyed.withColumn("_range", F.lit(0))
    before, starts = 0, []
    for r in sorted(keyed.groupBy("_range").count().collect()):
        starts.append((r["_range"], before))
        before += r["count"]
    starts = rows.sparkSession.createDataFrame(starts, "_range int, _start long")
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_key"))
    placed = keyed.join(F.broadcast(starts), "_range").withColumn(name, within + F.col("_start"))
    return placed.select(*rows.columns, name)


def quantiles(rows: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles of a number, by linear interpolation between the two values around each; null and NaN don't count.

    Each pass counts the values in BINS bins between two bounds, and the bin with the wanted rank gives the next bounds: what
    reaches the driver is a row a bin, and no task holds more than its own counts. A few passes suffice, as each narrows the
    bounds by BINS or ends at a value; all ranks are looked for together.
    """
    given = rows.select(F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    low, high, n = given.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not n:
        return [None] * len(shares)
    ranks = {r for q in shares for r in (math.floor(q * (n - 1)), math.ceil(q * (n - 1)))}
    known: dict[int, float] = {}
    # (bounds, of which both belong to it; rows below; ranks in it)
    open_ = [(low, high, 0, sorted(ranks))]
    while open_:
        narrow = []
        for low, high, below, wanted in open_:
            middle = low + (high - low) / 2 if math.isfinite(high - low) else low / 2 + high / 2
            if not low < middle < high:
                # No double lies between the bounds, so each value is one of them.
                few = given.where((F.col("v") == low)).count()
                known.update({r: low if r < below + few else high for r in wanted})
                continue
            width = (high - low) / BINS
            # Bins of equal width, or halves where doubles don't hold the width.
            even = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor((F.col("v") - low) / (width or 1.0))))
            at = even if width and math.isfinite(width) else F.when(F.col("v") < middle, 0).otherwise(1)
            own = given.where((F.col("v") >= low) & (F.col("v") <= high))
            for r in sorted(own.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("rows"), F.min("v").alias("low"), F.max("v").alias("high")).collect()):
                here = [w for w in wanted if below <= w < below + r["rows"]]
                if here:
                    narrow.append((r["low"], r["high"], below, here))
                below += r["rows"]
        open_ = narrow
    out = []
    for q in shares:
        at = q * (n - 1)
        a, b = known[math.floor(at)], known[math.ceil(at)]
        out.append(a if a == b else a + (b - a) * (at - math.floor(at)))
    return out
