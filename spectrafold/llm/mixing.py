"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free, text_of, written


def source_targets(sized: DataFrame, max_epochs: int) -> DataFrame:
    """One row a source: rank by code point (null last), its words, weight 1, 2, 3, repeating, and target words.

    The targets fill up like connected vessels: share = weight x level, but never above max_epochs x words. Sources in the
    order of cap / weight are capped until the level that the rest then gets is below their own. The windows run over one
    row a source, whatever the number of documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    ranked = per.withColumn("src", rank).withColumn("weight", (F.col("src") - 1) % 3 + 1).withColumn("cap", F.lit(max_epochs) * F.col("source_size"))
    every = Window.partitionBy()
    before = Window.orderBy((F.col("cap").cast("double") / F.col("weight")).asc(), F.col("src").asc()).rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.select(
        "*",
        F.sum("source_size").over(every).alias("all_words"),
        F.sum("weight").over(every).alias("all_weight"),
        F.coalesce(F.sum("cap").over(before), F.lit(0)).alias("capped"),
        F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("capped_weight"),
    )
    left, left_weight = (F.col("all_words") - F.col("capped")).cast("double"), (F.col("all_weight") - F.col("capped_weight")).cast("double")
    filled = filled.withColumn("open", F.col("cap") * left_weight > F.col("weight") * left)
    at = F.struct((F.col("cap").cast("double") / F.col("weight")), F.col("src"), left.alias("left"), left_weight.alias("left_weight"))
    filled = filled.withColumn("first_open", F.min(F.when(F.col("open"), at)).over(every))
    share = F.col("weight") * F.col("first_open.left") / F.col("first_open.left_weight")
    cap = F.col("cap").cast("double")
    return filled.select("source", "src", "source_size", "all_words", F.least(cap, F.coalesce(share, cap)).alias("target"))


def apportion(children: DataFrame, group: list[str], child: str, weight: str, seats: str, out: str) -> DataFrame:
    """Sainte-Lague: give each group's seats to the children with the highest quotients weight / (1, 3, 5, ...).

    Ties go to the smaller child. The quotient of the last seat is found by halving an interval over the group's weights, so
    seats are never listed one by one. A group has as many rows as there are sources, or at most `band` shards.
    """
    per = children.groupBy(*group).agg(F.collect_list(F.col(weight).cast("double")).alias("_w"), F.first(seats).alias("_m"))
    won = lambda w, x: F.floor(w / (2 * x) + 0.5)
    total = F.aggregate("_w", F.lit(0.0), lambda s, w: s + w)

    def halve(s, _):
        mid = (s["lo"] + s["hi"]) / 2
        many = F.aggregate("_w", F.lit(0).cast("long"), lambda n, w: n + won(w, mid)) > F.col("_m")
        return F.struct(F.when(many, mid).otherwise(s["lo"]).alias("lo"), F.when(many, s["hi"]).otherwise(mid).alias("hi"))

    start = F.struct((F.col("_t") / (2 * (F.col("_m") + F.size("_w")))).alias("lo"), (F.col("_t") * 2).alias("hi"))
    cut = F.when((F.col("_m") > 0) & (F.col("_t") > 0), F.aggregate(F.sequence(F.lit(1), F.lit(80)), start, halve)["hi"])
    per = per.withColumn("_t", total).select(*group, F.col("_m").cast("long").alias("_m"), cut.alias("_x"))
    base = children.join(per, group)
    base = base.withColumn("_n", F.coalesce(won(F.col(weight), F.col("_x")), F.lit(0)).cast("long"))
    whole = Window.partitionBy(*group)
    turn = Window.partitionBy(*group).orderBy((F.col(weight) / (2 * F.col("_n") + 1)).desc(), F.col(child).asc())
    base = base.withColumn("_r", F.col("_m") - F.sum("_n").over(whole)).withColumn("_k", F.row_number().over(turn))
    more = F.when(F.col("_x").isNotNull() & (F.col("_k") <= F.col("_r")) & (F.col(weight) > 0), 1).otherwise(0)
    return base.withColumn(out, F.col("_n") + more).drop("_m", "_x", "_n", "_r", "_k")


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    block_words: int = 32,
    shard_words: int = 16384,
    band: int = 1024,
    max_epochs: int = 3,
    seed: str = "mix-1",
) -> DataFrame:
    """How many words of each document a mix of all sources takes.

    Sources are cut into shards of about `shard_words` words by a seeded hash of the document, and each shard's documents,
    in a seeded order, into blocks of `block_words` words (fewer in tiny corpora: at least 4,096 blocks, where there are as
    many words). Sainte-Lague deals the blocks of the whole mix to sources, a source's to bands of shards, a band's to its
    shards. A shard that gets more blocks than it has repeats all of them, and a seeded draw picks the rest.

    Returns (id, size, source_size, target, taken, source), one row for each input row. Null text: size 0. A null source is
    a source of its own, after the others. Rows that are equal are separate rows. No input: no rows. Other columns of the
    input are not touched.
    """
    sized = written(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size")), "sized")
    sources = source_targets(sized, max_epochs)
    sources = sources.withColumn("words", F.least(F.lit(block_words), F.greatest(F.lit(1), F.floor(F.col("all_words") / 4096))).cast("long"))
    sources = sources.withColumn("all_seats", F.round(F.col("all_words") / F.col("words")).cast("long")).withColumn("_all", F.lit(0))
    sources = apportion(sources, ["_all"], "src", "target", "all_seats", "source_seats")
    sources = written(sources.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words))).drop("_all", "all_words", "all_seats"), "sources")

    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    named = sources.withColumnRenamed("source", "_source")
    named_rows = sized.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # Rows without words take no place in a shard, however many there are.
    blank = named_rows.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), "source")
    placed = named_rows.where("size > 0")
    placed = placed.withColumn("key", key).withColumn("shard", (F.conv(F.substring("key", 1, 8), 16, 10).cast("long") % F.col("shards")))
    order = Window.partitionBy("src", "shard").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum("size").over(order), F.lit(0)))
    placed = written(placed.select("doc_id", "source", "size", "source_size", "target", "src", "shard", "start", "words", "source_seats"), "placed")

    cells = placed.groupBy("src", "shard").agg(F.sum("size").alias("length"), F.first("words").alias("words"), F.first("source_seats").alias("source_seats"))
    cells = cells.withColumn("band", F.floor(F.col("shard") / band))
    bands = cells.groupBy("src", "band").agg(F.sum("length").alias("band_length"), F.first("source_seats").alias("source_seats"))
    bands = apportion(bands, ["src"], "band", "band_length", "source_seats", "band_seats").select("src", "band", "band_seats")
    cells = apportion(cells.join(bands, ["src", "band"]), ["src", "band"], "shard", "length", "band_seats", "quota")
    cells = cells.withColumn("blocks", F.ceil(F.col("length") / F.col("words"))).where("blocks > 0")
    cells = cells.withColumn("quota", F.least(F.col("quota"), max_epochs * F.col("blocks")))
    cells = written(cells.select("src", "shard", "blocks", F.expr("quota div blocks").alias("epochs"), F.expr("quota % blocks").alias("extra")), "cells")

    # A few rows here become many: they are dealt out before that, and their size afterwards can't be estimated, so no broadcast.
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = cells.where("extra > 0").repartition(spread, "src", "shard").select("src", "shard", "extra", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    draw = F.md5(F.concat_ws("|", F.lit(seed), "src", "shard", "block"))
    drawn = blocks.withColumn("turn", F.row_number().over(Window.partitionBy("src", "shard").orderBy(draw, "block"))).where("turn <= extra").select("src", "shard", "block")

    spans = placed.select("*", F.explode(F.sequence(F.expr("start div words"), F.expr("(start + size - 1) div words"))).alias("block"))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("words")) - F.greatest(F.col("start"), F.col("block") * F.col("words"))
    partly = spans.join(drawn.hint("merge"), ["src", "shard", "block"]).groupBy("src", "shard", "start").agg(F.sum(overlap).alias("part"))
    sizes = placed.join(partly, ["src", "shard", "start"], "left").join(cells, ["src", "shard"], "left")
    taken = (F.coalesce("epochs", F.lit(0)) * F.col("size") + F.coalesce("part", F.lit(0))).cast("long").alias("taken")
    return sizes.select("doc_id", "size", "source_size", "target", taken, "source").unionByName(blank)


def mixed_documents(docs: DataFrame, *, seed: str = "mix-1", **options) -> DataFrame:
    """The mix itself: each document as often as the mix takes it, whole; all columns stay.

    A document of which the mix takes 2.3 times its words comes twice, and with a chance of 0.3, drawn by a seeded hash, a
    third time. Documents of which it takes nothing, or that have no words, go. Equal rows are taken alike.
    """
    row, times, copy, many = (free(docs, n) for n in ("_row", "_times", "_copy", "_copies"))
    keyed = docs.withColumn(row, F.xxhash64("doc_id", "source", "text"))
    share = mix(keyed, id_col=row, seed=seed, **options).where("taken > 0").groupBy(F.col("doc_id").alias(row)).agg(F.avg(F.col("taken") / F.col("size")).alias(times))
    chance = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), row)), 1, 8), 16, 10).cast("double") / 2.0**32
    copies = (F.floor(times) + F.when(chance < F.col(times) - F.floor(times), 1).otherwise(0)).cast("int")
    share = share.withColumn(many, copies).where(F.col(many) > 0).select(row, many)
    return keyed.join(share, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(many)))).select(*docs.columns)
