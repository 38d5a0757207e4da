"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of characters, trained on trusted text."""

from __future__ import annotations

import math
import re
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyarrow import parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, held, text_of, written
from .shingles import mixed

#: Symbols in an n-gram, bits of a symbol, probabilities in a shard, and bytes of shards that a worker keeps.
ORDER, BITS, SHARD, HELD_BYTES = 5, 12, 4_000_000, 128_000_000
#: Bits of the filter that picks the texts to train on before they are joined with their labels.
FILTER_BITS = 1 << 24
#: Characters of text whose n-grams are gathered at once.
GATHER = 2_000_000
START, STOP = 4094, 4095
#: A code point from here up is two symbols: a lead, which is from here up itself, and a trail, which is below. The leads
#: reach for all of Unicode and end below START, so each character has symbols of its own.
LEADS = 3800
#: Of the trusted documents, one in so many is held out of the training and gives the quantiles.
HELD_OUT = 5
#: The high quantile counts as so much at least, as trusted documents may be all alike.
LEAST_SPREAD = 0.5
#: With so many documents to a language, its high quantile is widened by sqrt(2), and by less with more.
FEW = 10


def symbols(text: str) -> np.ndarray:
    """The symbols of a text: one for each code point below LEADS, a lead and a trail for each other one."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    high = points >= LEADS
    if not high.any():
        return points
    lead, trail = np.divmod(points - LEADS, LEADS)
    both = np.stack([np.where(high, LEADS + lead, points), np.where(high, trail, -1)], 1).reshape(-1)
    return both[both >= 0]


def grams(text: str) -> np.ndarray:
    """The n-grams that end at each symbol and at the end of the text, as integers of BITS a symbol."""
    own = symbols(text)
    line = np.concatenate([np.full(ORDER - 1, START), own, [STOP]])
    out = line[: len(own) + 1].copy()
    for i in range(1, ORDER):
        out = (out << BITS) | line[i : i + len(own) + 1]
    return out


def _counted(rows: DataFrame) -> DataFrame:
    """(gram, c): counts over the texts of the first column, added up in each task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("grams", object)
        waiting, size = [], 0
        total = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def add() -> None:
            nonlocal total, waiting, size
            keys, counts = np.unique(np.concatenate(waiting), return_counts=True)
            both, where = np.unique(np.concatenate([total[0], keys]), return_inverse=True)
            total, waiting, size = (both, np.bincount(where, np.concatenate([total[1], counts]), len(both)).astype(np.int64)), [], 0

        for batch in batches:
            for text in batch.column(0):
                waiting.append(grams(text.as_py()))
                size += len(waiting[-1])
                if size >= GATHER:
                    add()
            if len(total[0]) > GATHER:
                yield pa.RecordBatch.from_arrays([pa.array(total[0]), pa.array(total[1])], ["gram", "c"])
                total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if waiting:
            add()
        if len(total[0]):
            yield pa.RecordBatch.from_arrays([pa.array(total[0]), pa.array(total[1])], ["gram", "c"])

    return rows.mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def _some(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents with these ids: a fixed-size filter first, so that few texts reach the exact join."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            out[mixed(batch.column(0).to_numpy().astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)] = True
        packed = np.packbits(out).reshape(64, -1)
        held = [i for i in range(64) if packed[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([packed[i].tobytes() for i in held], pa.binary())], ["block", "bits"])

    packed = np.zeros((64, FILTER_BITS // 512), np.uint8)
    for row in ids.coalesce(16).mapInArrow(bits, "block int, bits binary").toLocalIterator():
        packed[row["block"]] |= np.frombuffer(row["bits"], np.uint8)
    sent = docs.sparkSession.sparkContext.broadcast(packed.reshape(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            at = mixed(batch.column(0).to_numpy().astype(np.int64).view(np.uint64)) % np.uint64(FILTER_BITS)
            keep = sent.value[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1
            yield batch.filter(pa.array(keep.astype(bool)))

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string").join(ids, "doc_id", "left_semi")


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2, and 3 or more, from how many n-grams have counts 1 to 4."""
    n1, n2, n3, n4 = counts.agg(*(F.count_if(F.col("c") == i) for i in (1, 2, 3, 4))).first()
    if not n1 or not n2:
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    first, second = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2
    third = 3 - 4 * y * n4 / n3 if n3 else second
    return tuple(min(max(d, 0.05), i + 0.0) for i, d in enumerate((first, second, third), 1))


def _discount(c: Column, d: tuple[float, float, float]) -> Column:
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def probabilities(counts: DataFrame, needed: DataFrame) -> DataFrame:
    """(gram, p) of the needed n-grams of full length, by joins of the counts of each order, all dealt by n-gram.

    Lower orders count in how many different contexts an n-gram was seen. An n-gram's probability is its discounted share
    of its context's count, plus what the discounts left over times the probability of the n-gram without its first
    character; a context that was never seen leaves everything to the latter. Characters are uniform below order 1.
    """
    tables = {ORDER: counts}
    for order in range(ORDER - 1, 0, -1):
        mask = (1 << (BITS * order)) - 1
        tables[order] = written(tables[order + 1].groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.count("*").alias("c")), f"order{order}")
    wanted = {ORDER: needed}
    for order in range(ORDER - 1, 0, -1):
        wanted[order] = wanted[order + 1].select(F.col("gram").bitwiseAND(F.lit((1 << (BITS * order)) - 1)).alias("gram")).distinct()
    lower = None
    for order in range(1, ORDER + 1):
        table, d = tables[order], discounts(tables[order])
        before = F.shiftright("gram", BITS).alias("context")
        c = F.col("c")
        contexts = table.groupBy(before).agg(F.sum("c").alias("total"), F.sum(_discount(c, d)).alias("left"))
        rows = wanted[order].join(table, "gram", "left").withColumn("context", F.shiftright("gram", BITS)).join(contexts, "context", "left")
        if lower is None:
            base = F.lit(1.0 / (1 << BITS))
        else:
            rows = rows.withColumn("short", F.col("gram").bitwiseAND(F.lit((1 << (BITS * (order - 1))) - 1))).join(lower, "short")
            base = F.col("p_short")
        share = F.when(c.isNull(), 0.0).otherwise((c - _discount(c, d)) / F.col("total"))
        p = F.when(F.col("total").isNull(), base).otherwise(share + F.col("left") / F.col("total") * base)
        lower = written(rows.select(F.col("gram").alias("short"), p.alias("p_short")), f"p{order}")
    return lower.select(F.col("short").alias("gram"), F.col("p_short").alias("p"))


class Shards:
    """Probabilities in files by ranges of n-grams, read from the shared folder as they are needed; some of them are kept."""

    def __init__(self, files: list[tuple[str, int]]):
        """files: (address, lowest n-gram) in the order of the n-grams."""
        self.files, self.low = [f for f, _ in files], np.array([low for _, low in files], np.int64)
        self.kept: OrderedDict[int, tuple[np.ndarray, np.ndarray]] = OrderedDict()

    def shard(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(n-grams in order, bits)."""
        if i in self.kept:
            self.kept.move_to_end(i)
            return self.kept[i]
        while self.kept and sum(k.nbytes + b.nbytes for k, b in self.kept.values()) > HELD_BYTES:
            self.kept.popitem(last=False)
        address = re.sub("^s3[an]:", "s3:", re.sub("^file:/+", "file:///", self.files[i]))
        system, path = pafs.FileSystem.from_uri(address)
        got = pq.read_table(path, filesystem=system)
        self.kept[i] = got.column("gram").to_numpy(), -np.log2(got.column("p").to_numpy()).astype(np.float32)
        return self.kept[i]

    def bits(self, kinds: np.ndarray) -> np.ndarray:
        """Bits of n-grams that come in order: a merge of them with each shard that holds some."""
        out = np.zeros(len(kinds))
        cuts = np.append(np.searchsorted(kinds, self.low[1:]), len(kinds)) if len(self.low) else np.zeros(0, np.int64)
        starts = [0, *cuts.tolist()]
        # Shards at hand first, so that of many shards only those are read again that don't fit.
        for i in sorted(range(len(cuts)), key=lambda i: i not in self.kept):
            at, end = starts[i], starts[i + 1]
            if at < end:
                keys, bits = self.shard(i)
                place = np.minimum(np.searchsorted(keys, kinds[at:end]), len(keys) - 1)
                out[at:end] = np.where(keys[place] == kinds[at:end], bits[place], 0.0)
        return out


def _shards(files: tuple[tuple[str, int], ...]) -> Shards:
    return held(("shards", files), lambda: Shards(list(files)))


def _scored(docs: DataFrame, p: DataFrame) -> DataFrame:
    """(doc_id, key, lang, n, bits) of each row: characters (the end of the text counts as one) and their surprise in bits.

    The probabilities are dealt into shards by ranges of n-grams and written to the shared folder. Each task joins the
    n-grams of its texts with the shards that hold them, so the texts are read once and nothing passes through the driver
    but the shards' names.
    """
    many = max(1, math.ceil(p.count() / SHARD))
    table = written(p.repartitionByRange(many, "gram").sortWithinPartitions("gram"), "shards")
    files = table.groupBy(F.input_file_name().alias("file")).agg(F.min("gram").alias("low")).orderBy("low").collect()
    files = tuple((unquote(r["file"]), r["low"]) for r in files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _shards(files)
        for batch in batches:
            sizes, sums = np.zeros(len(batch), np.int64), np.zeros(len(batch))
            texts = [t.as_py() for t in batch.column(3)]
            first = 0
            while first < len(texts):
                last, size = first, 0
                while last < len(texts) and (last == first or size + len(texts[last]) < GATHER // 2):
                    size += len(texts[last])
                    last += 1
                own = [grams(t) for t in texts[first:last]]
                kinds, where = np.unique(np.concatenate(own), return_inverse=True)
                value = shards.bits(kinds)[where]
                ends = np.cumsum([len(g) for g in own])
                sizes[first:last] = [len(t) for t in texts[first:last]]
                sums[first:last] = np.add.reduceat(value, np.concatenate([[0], ends[:-1]]))
                first = last
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes), pa.array(sums)], ["doc_id", "key", "lang", "n", "bits"])

    return written(docs.select("doc_id", "key", "lang", "text").mapInArrow(run, "doc_id long, key long, lang string, n long, bits double"), "scored")


def quantiles(scores: DataFrame, shares: dict[str, float], step: float = 0.002) -> DataFrame:
    """(lang, one column a share): quantiles of score by language, to the step.

    Scores are counted in bins of the step before anything is sorted, so a language's rows never meet in one task.
    """
    bins = scores.groupBy("lang", F.floor(F.col("score") / step).alias("bin")).agg(F.count("*").alias("rows"))
    up_to = F.sum("rows").over(Window.partitionBy("lang").orderBy("bin"))
    share = bins.withColumn("share", up_to / F.sum("rows").over(Window.partitionBy("lang")))
    return share.groupBy("lang").agg(*(((F.min(F.when(F.col("share") >= v, F.col("bin"))) + 0.5) * step).alias(k) for k, v in shares.items()))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """(doc_id, lang, n, bits_per_char, limit, keep) of each row.

    labels (doc_id, quality, toxic) name the trusted documents: quality 1 and toxic 0. Four fifths of them, by a hash of
    the id, train the model; counts cover all their text. The others give each language's median of bits a character and
    two quantiles of what they differ from it by, in units of

        unit = sqrt(1 / characters + drift ** 2),

    as a mean over many characters varies less. A document is rejected beyond

        limit = median + quantile x unit + BITS / (characters + 1),

    the last so that one character never decides about a short text, the quantile being that of the language's own trusted documents which the share false_rejections of them exceed, and
    at least `spreads` times their `high` quantile, as few documents say nothing about so small a share; both are widened
    where few documents give them (FEW).

    Perplexity is 2 ** bits_per_char. A language without trusted documents (a null one is a language, too) takes the
    quantiles of all. Null or empty texts have no perplexity and stay, as does everything if nothing is trusted. Equal rows
    stay separate; an id may repeat, and its rows are judged one by one; other columns are left out. No input: no rows.
    """
    return _judged(docs, labels, F.lit(0), id_col, text_col, lang_col, **options).drop("key")


def _judged(docs: DataFrame, labels: DataFrame, key: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", high: float = 0.95, spreads: float = 2.0, false_rejections: float = 0.002, drift: float = 0.02) -> DataFrame:
    """The same with a key of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"), key.cast("long").alias("key"))
    trusted = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = written(trusted.withColumn("held", F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0), "trusted")
    train = _some(rows, trusted.where("not held").select("doc_id"))
    counts = written(_counted(train.select("text")), "counts")
    needed = written(_counted(rows.select("text")).select("gram"), "needed")
    scored = _scored(rows, probabilities(counts, needed))
    scored = scored.withColumn("bits_per_char", F.when(F.col("n") > 0, F.col("bits") / (F.col("n") + 1)))

    unit = F.sqrt(1 / F.greatest(F.col("n"), F.lit(1)) + drift**2)
    judges = scored.where("n > 0").join(trusted.where("held").select("doc_id"), "doc_id", "left_semi").select("lang", F.col("bits_per_char").alias("score"), unit.alias("unit"))
    judges = written(judges, "judges")
    everything = F.lit("").alias("lang")

    def with_own(rows: DataFrame, table: DataFrame, *names: str) -> DataFrame:
        """The rows with what the table has for their language."""
        own = table.select(F.col("lang").alias("_lang"), *names)
        return rows.join(own, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")

    def limits(judges: DataFrame) -> DataFrame:
        """(lang, middle, beyond): each language's median, and how many units beyond it a document may be."""
        middles = written(quantiles(judges, {"middle": 0.5}), "middles")
        beyond = with_own(judges, middles, "middle").select("lang", ((F.col("score") - F.col("middle")) / F.col("unit")).alias("score"))
        found = quantiles(beyond, {"high": high, "last": 1 - false_rejections})
        few = beyond.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("rows"))
        found = found.join(few, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
        own = F.greatest(F.col("last"), spreads * F.greatest(F.col("high"), F.lit(LEAST_SPREAD))) * F.sqrt(1 + FEW / F.col("rows"))
        return written(with_own(found.select("lang", own.alias("beyond")), middles, "middle"), "limits")

    own, all_ = limits(judges), limits(judges.select(everything, "score", "unit"))
    # One row for each language, and one in all, null if nothing is trusted.
    every = F.broadcast(written(all_.agg(F.first("middle").alias("middle_all"), F.first("beyond").alias("beyond_all")), "limit_all"))
    placed = with_own(scored, own, "middle", "beyond").crossJoin(every)
    placed = placed.withColumn("limit", F.coalesce("middle", "middle_all") + F.coalesce("beyond", "beyond_all") * unit + BITS / (F.col("n") + 1))
    keep = F.coalesce(F.col("bits_per_char") <= F.col("limit"), F.lit(True)).alias("keep")
    return placed.select("doc_id", "key", "lang", "n", "bits_per_char", "limit", keep)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the classifier keeps, with all their columns; each row is judged by its own text, whatever its id."""
    key = free(docs, "_row")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "lang", text_of()))
    bad = _judged(keyed, labels, F.col(key), **options).where("not keep").select(F.col("key").alias(key)).distinct()
    return keyed.join(bad, key, "left_anti").select(*docs.columns)
