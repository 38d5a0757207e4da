"""Token ids on disk, compressed shard by shard with a Re-Pair grammar that can be read from any place."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import shared_dir, text_of, written

#: Ids in a shard, pairs that are replaced in one pass, and the fewest occurrences that make a rule: a rule takes 8 bytes or
#: more, and each use of it saves one symbol of 2 or 4.
SHARD_IDS, PAIRS, LEAST = 1_000_000, 8192, 8
MAGIC = b"SFRP1"


def repair(ids: np.ndarray, base: int, pairs: int = PAIRS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Replace the most frequent pairs of neighbours by new symbols, a batch of pairs at a time, until none is left that occurs often enough.

    Returns (sequence, left, right, lengths): symbol base + i stands for left[i], right[i] and expands to lengths[i] ids.
    Of overlapping occurrences, the first, third and so on of each run are replaced.
    """
    seq = ids.astype(np.uint32)
    left, right, lengths = [], [], []
    size = base
    bits = 20
    while len(seq) >= 2 * least:
        key = seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:]
        bins = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)
        counts = np.bincount(bins, minlength=1 << bits)
        often = counts[counts >= least]
        limit = int(np.partition(often, -pairs)[-pairs]) if len(often) > pairs else least
        at = np.flatnonzero((counts >= limit)[bins])
        if not len(at):
            break
        if bits == 20:  # at first nearly all pairs are in question: each bin counts one of its own, the others wait
            bits, holder = 18, np.empty(1 << 20, np.uint64)
            where, some = bins[at], key[at]
            holder[where] = some
            own = holder[where] == some
            at, where = at[own], where[own]
            each, keys = np.bincount(where, minlength=1 << 20), holder
            best = np.flatnonzero(each >= least)
            if not len(best):
                continue
        else:
            keys, where, each = np.unique(key[at], return_inverse=True, return_counts=True)
            best = np.flatnonzero(each >= least)
        if not len(best) and limit > least:  # the fullest counters hold several rarer pairs each: look at all of them
            at = np.flatnonzero((counts >= least)[bins])
            keys, where, each = np.unique(key[at], return_inverse=True, return_counts=True)
            best = np.flatnonzero(each >= least)
        if not len(best):
            break
        best = best[np.argsort(-each[best], kind="stable")[:pairs]]
        symbol = np.zeros(len(keys), np.uint32)
        symbol[best] = size + np.arange(len(best), dtype=np.uint32)
        new = symbol[where]
        used = np.flatnonzero(new)
        at, new = at[used], new[used]
        starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        run = np.repeat(starts, np.diff(starts, append=len(at)))
        odd = (np.arange(len(at)) - run) % 2 == 0
        at, new = at[odd], new[odd]
        seq[at] = new
        stays = np.ones(len(seq), bool)
        stays[at + 1] = False
        seq = seq[stays]
        a, b = (keys[best] >> np.uint64(32)).astype(np.uint32), (keys[best] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        known = np.concatenate([np.zeros(0, np.uint32), *lengths])
        length = lambda s, known=known: np.where(s < base, 1, known[np.maximum(s.astype(np.int64) - base, 0)] if len(known) else 1)
        left.append(a)
        right.append(b)
        lengths.append((length(a) + length(b)).astype(np.uint32))
        size += len(best)
    none = np.zeros(0, np.uint32)
    return seq, np.concatenate([none, *left]), np.concatenate([none, *right]), np.concatenate([none, *lengths])


def expand(seq: np.ndarray, base: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The ids that a sequence of symbols stands for, all symbols opened level by level."""
    seq = seq.astype(np.uint32)
    while len(left) and len(at := np.flatnonzero(seq >= base)):
        wide = np.ones(len(seq), np.int64)
        wide[at] = 2
        rule = seq[at].astype(np.int64) - base
        seq, first = np.repeat(seq, wide), np.cumsum(wide)[at] - 2
        seq[first], seq[first + 1] = left[rule], right[rule]
    return seq


def expand_whole(seq: np.ndarray, base: int, left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The same for a long sequence: the rules are opened once, and each symbol copies what its rule stands for."""
    ends = np.cumsum(lengths, dtype=np.int64)
    if not len(left) or ends[-1] > 2 * len(seq):
        return expand(seq, base, left, right)
    table = np.concatenate([expand(np.arange(base, base + len(left)), base, left, right), seq.astype(np.uint32)])
    rule = np.flatnonzero(seq >= base)
    wide, start = np.ones(len(seq), np.int64), np.arange(len(seq)) + int(ends[-1])
    which = seq[rule].astype(np.int64) - base
    wide[rule], start[rule] = lengths[which], ends[which] - lengths[which]
    return table[np.arange(int(wide.sum())) + np.repeat(start - np.cumsum(wide) + wide, wide)]


def pack(ids: np.ndarray, base: int) -> bytes:
    """One shard: magic, base, counts, rules, expansion lengths, sequence; all little-endian."""
    seq, left, right, lengths = repair(ids, base)
    wide = "<u2" if base + len(left) <= 1 << 16 else "<u4"
    head = MAGIC + struct.pack("<BIII", int(wide[-1]), base, len(left), len(seq))
    return head + left.astype(wide).tobytes() + right.astype(wide).tobytes() + lengths.astype("<u4").tobytes() + seq.astype(wide).tobytes()


class Shard:
    """Reads a packed shard; ids can be read from any place without expanding what stands before."""

    def __init__(self, blob: bytes):
        if blob[:5] != MAGIC:
            raise ValueError("not a shard of token ids")
        width, self.base, rules, symbols = struct.unpack_from("<BIII", blob, 5)
        at, kind = 5 + struct.calcsize("<BIII"), f"<u{width}"

        def take(n: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        self.left, self.right = take(rules, kind).astype(np.uint32), take(rules, kind).astype(np.uint32)
        self.lengths, self.seq = take(rules, "<u4"), take(symbols, kind)
        self.ends = None

    def all(self) -> np.ndarray:
        return expand_whole(self.seq, self.base, self.left, self.right, self.lengths)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop: expands only the symbols that cover them."""
        if self.ends is None:
            wide = np.ones(len(self.seq), np.int64)
            rule = self.seq >= self.base
            wide[rule] = self.lengths[self.seq[rule].astype(np.int64) - self.base]
            self.ends = np.cumsum(wide)
        if start >= stop:
            return np.zeros(0, np.uint32)
        first, last = np.searchsorted(self.ends, [start, stop - 1], "right")
        before = self.ends[first - 1] if first else 0
        return expand(self.seq[first : last + 1], self.base, self.left, self.right)[start - before : stop - before]


STORED = "part int, shard int, n_docs long, n_ids long, doc_ids array<long>, counts array<long>, ids binary"


def write(docs: DataFrame, tokenizer: str, path: str, *, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> None:
    """Encode all texts, end each with end_id, and write the ids in ascending order of the documents' ids.

    The table at path has a row a shard: its place (part, shard), the ids and id counts of its documents, and the packed
    grammar. Null text is empty: end_id alone. A null id comes first. Rows with one id stand in the order of a hash of
    their texts, so that many rows of one id are dealt to several tasks.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    ranged = rows.repartitionByRange("doc_id", "mark").sortWithinPartitions("doc_id", "mark", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = vocabulary(tokenizer), TaskContext.get().partitionId()
        base = max(words.size, end_id + 1)
        end = np.array([end_id], np.uint32)
        held, shard = ([], [], [], 0), 0

        def shut() -> pa.RecordBatch:
            nonlocal held, shard
            names, counts, parts, total = held
            row = {"part": part, "shard": shard, "n_docs": len(names), "n_ids": total, "doc_ids": names, "counts": counts, "ids": pack(np.concatenate(parts), base)}
            held, shard = ([], [], [], 0), shard + 1
            kinds = {"part": pa.int32(), "shard": pa.int32(), "n_docs": pa.int64(), "n_ids": pa.int64(), "doc_ids": pa.list_(pa.int64()), "counts": pa.list_(pa.int64()), "ids": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in kinds.items()], list(kinds))

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = words.encode(text.as_py())
                held[0].append(name)
                held[1].append(len(ids) + 1)
                held[2].extend((ids, end))
                held = (*held[:3], held[3] + len(ids) + 1)
                if held[3] >= shard_ids:
                    yield shut()
        if held[0]:
            yield shut()

    ranged.mapInArrow(run, STORED).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each stored document, from the files alone."""
    shards = spark.read.schema(STORED).parquet(path)
    sizes = shards.select("part", "shard", "n_ids")
    # One row a task that wrote shards; the shards of each are added up by themselves.
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.join(parts.select("part", before.alias("before")), "part")
    begins = written(begins.select("part", "shard", (F.col("before") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("begin")), "begins")
    placed = shards.join(begins, ["part", "shard"]).select("begin", "doc_ids", "counts", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, names, counts, blob in zip(*(c for c in batch.columns), strict=True):
                ids = Shard(blob.as_py()).all().astype("<u4")
                counts = np.array(counts.as_py(), np.int64)
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                sums = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [names.values, pa.array(begin.as_py() + ends - counts), pa.array(counts), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write the ids of all documents to the shared folder and report them from there. No input: no rows."""
    path = f"{shared_dir(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    write(docs, tokenizer, path, **options)
    return read(docs.sparkSession, path)
