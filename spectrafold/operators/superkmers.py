"""K-mers counted bucket by bucket: sequences are cut into super-k-mers, which are shuffled with two bits a base.

The minimiser of a k-mer is the least of its m-mers in a mixed order. Neighbouring k-mers mostly have the same one, so a
sequence falls into stretches, the super-k-mers, whose k-mers all go to the bucket of that minimiser. A k-mer is thus counted
in one bucket wherever it stands, and each base is shuffled a few times rather than once for each k-mer that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least k that is counted this way, bases of a minimiser, buckets to a shuffle partition, and k-mers that are sorted at once.
PACKED, MINIMISER, BUCKETS, SORTED = 13, 9, 4, 2_000_000

CODE = np.full(256, 4, np.uint8)
CODE[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4)


def codes(digits: np.ndarray, k: int) -> np.ndarray:
    """Integer of each window of base digits, two bits a base."""
    n = len(digits) - k + 1
    out = np.zeros(max(0, n), np.int64)
    for i in range(k if n > 0 else 0):
        out = (out << 2) | digits[i : i + n]
    return out


def spelled(kinds: np.ndarray, k: int) -> np.ndarray:
    """The k-mers of integers, as byte strings."""
    places = (kinds[:, None] >> (2 * np.arange(k - 1, -1, -1))) & 3
    return np.frombuffer(b"ACGT", np.uint8)[places].view(f"S{k}")[:, 0]


def minimisers(digits: np.ndarray, k: int, canonical: bool) -> np.ndarray:
    """The minimiser of each window of length k, mixed; of a canonical k-mer, it is the same on both strands."""
    m = min(MINIMISER, k)
    own = codes(digits.astype(np.int64), m)
    if canonical:
        own = np.minimum(own, codes(3 - digits[::-1].astype(np.int64), m)[::-1])
    mixed = (own * 0x9E3779B1 + 0x7F4A7C15) & 0xFFFFFFFF
    mixed ^= mixed >> 15
    width, out = k - m + 1, mixed
    # The least of `width` neighbours, from that of half as many, and so on.
    have = 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def packed(data: bytes, k: int, buckets: int, canonical: bool) -> Iterator[tuple[int, bytes, bytes]]:
    """(bucket, lengths, bases) of the super-k-mers of a piece, a row a bucket that has some."""
    digits = CODE[np.frombuffer(data, np.uint8)]
    if len(digits) < k:
        return
    bad = np.concatenate([[0], np.cumsum(digits > 3)])
    good = bad[k:] == bad[:-k]
    least = minimisers(np.minimum(digits, 3), k, canonical)
    # A stretch begins where a valid window has another minimiser than the one before it, or follows an invalid one.
    first = good & np.concatenate([[True], (least[1:] != least[:-1]) | ~good[:-1]])
    last = good & np.concatenate([(least[1:] != least[:-1]) | ~good[1:], [True]])
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + k
    if not len(starts):
        return
    bucket = least[starts] % buckets
    order = np.argsort(bucket, kind="stable")
    starts, lengths, bucket = starts[order], (ends - starts)[order], bucket[order]
    room = -(-lengths // 4) * 4  # each stretch fills whole bytes
    flat = np.zeros(int(room.sum()), np.uint8)
    begin = np.cumsum(room) - room
    within = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    flat[np.repeat(begin, lengths) + within] = digits[np.repeat(starts, lengths) + within]
    quads = flat.reshape(-1, 4)
    both = (quads[:, 0] << 6) | (quads[:, 1] << 4) | (quads[:, 2] << 2) | quads[:, 3]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(bucket)], strict=True):
        to = int(begin[b]) if b < len(begin) else len(flat)
        yield int(bucket[a]), lengths[a:b].astype("<u4").tobytes(), both[int(begin[a]) // 4 : to // 4].tobytes()


def unpacked(lengths: bytes, bases: bytes, k: int, canonical: bool) -> np.ndarray:
    """The k-mers of packed super-k-mers, as integers."""
    size = np.frombuffer(lengths, "<u4").astype(np.int64)
    quads = np.frombuffer(bases, np.uint8)
    digits = np.stack([quads >> 6, (quads >> 4) & 3, (quads >> 2) & 3, quads & 3], 1).reshape(-1).astype(np.int64)
    room = -(-size // 4) * 4
    windows = size - k + 1
    within = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    at = np.repeat(np.cumsum(room) - room, windows) + within
    found = codes(digits, k)[at]
    if canonical:
        found = np.minimum(found, codes(3 - digits[::-1], k)[::-1][at])
    return found


def shuffled(rows: DataFrame, ks: list[int], canonical: bool) -> DataFrame:
    """(k, bucket, sample, lengths, bases): the super-k-mers of (sample, sequence, seen, only)."""
    from .kmers import pieces

    buckets = BUCKETS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sample, k, piece in pieces(batches, ks):
            found = list(packed(piece, k, buckets, canonical))
            if found:
                bucket, lengths, bases = zip(*found, strict=True)
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k, np.int32)), pa.array(bucket, pa.int32()), pa.array([sample] * n, pa.string()), pa.array(lengths, pa.binary()), pa.array(bases, pa.binary())], ["k", "bucket", "sample", "lengths", "bases"])

    return rows.mapInArrow(run, "k int, bucket int, sample string, lengths binary, bases binary")


def counts(rows: DataFrame, ks: list[int], canonical: bool) -> DataFrame:
    """counts(k, sample, feature, c) of (sample, sequence, seen, only).

    A task takes its buckets one by one and sample by sample, and holds the distinct k-mers of one sample in one bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        kinds, many = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def add() -> None:
            nonlocal kinds, many, held, size
            own, count = np.unique(np.concatenate(held), return_counts=True)
            both, where = np.unique(np.concatenate([kinds, own]), return_inverse=True)
            kinds, many, held, size = both, np.bincount(where, np.concatenate([many, count]), len(both)).astype(np.int64), [], 0

        def told() -> Iterator[pa.RecordBatch]:
            if held:
                add()
            if len(kinds):
                n = len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, now[0], np.int32)), pa.array([now[2]] * n, pa.string()), pa.array(spelled(kinds, now[0]).astype(str), pa.string()), pa.array(many)], ["k", "sample", "feature", "c"])

        for batch in batches:
            for *key, lengths, bases in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now:
                    yield from told()
                    now, kinds, many = key, kinds[:0], many[:0]
                held.append(unpacked(lengths, bases, key[0], canonical))
                size += len(held[-1])
                if size >= SORTED:
                    add()
        if now:
            yield from told()

    dealt = shuffled(rows, ks, canonical).repartition("k", "bucket").sortWithinPartitions("k", "bucket", "sample")
    return dealt.mapInArrow(run, "k int, sample string, feature string, c long")
