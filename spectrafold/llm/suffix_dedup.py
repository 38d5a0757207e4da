"""Removal of long repeated byte strings by bucket-pointer refinement, over anchors instead of all suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .shingles import mixed
from .vectors import runs

#: Bytes of the strings that make the first buckets (a power of two).
Q = 128
#: Bytes of the strings of the first bucket pointers and their distance, and of the longest.
STEP, LONGEST = 16, 256
#: Members of buckets that one task refines together, at least.
AT_ONCE = 4096
#: Widths of the ranges of starts of a bucket that is refined by joins; the first range holds all.
WIDTHS = (64, 8, 1)
#: Buckets of up to so many members are refined by one task; larger ones by joins, one after the other for all of them.
SMALL = 16_384
#: Bytes that are hashed at once.
GROUP_BYTES = 262_144
#: Fewest and most bits of the filter that picks texts before they are joined: 16 for each wanted row in between.
FILTER_BITS = 1 << 20, 1 << 27
#: Longest period that is looked for, and bytes to an anchor from which a text isn't searched for periods.
PERIOD, DENSE_ANCHORS = 16, 24

_BYTE = np.random.default_rng(20240503).integers(1, 2**63, 256, dtype=np.uint64)
_ODD = (np.random.default_rng(20240504).integers(1, 2**62, 8, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def string_ids(data: np.ndarray) -> np.ndarray:
    """An identifier of the Q bytes from each place: that of a string from those of its halves, again and again."""
    ids = _BYTE[data]
    step = 1
    for odd in _ODD:
        if step >= Q:
            break
        ids = ids[:-step] * odd + ids[step:]
        ids ^= ids >> np.uint64(29)
        step *= 2
    return ids * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)


def _sliding(x: np.ndarray, width: int, of: np.ufunc) -> np.ndarray:
    """of() over each run of `width` values, in two passes over blocks of that width."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.concatenate([x, np.full(blocks * width - n, x[-1])]).reshape(blocks, width)
    ahead = of.accumulate(padded, axis=1).reshape(-1)
    behind = of.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return of(behind[: n - width + 1], ahead[width - 1 : n])


def periodic(data: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(start, stop, period) of stretches that repeat themselves after up to PERIOD bytes, so that all strings of `length` bytes in them are repeats."""
    out = []
    for period in range(1, PERIOD + 1):
        breaks = np.flatnonzero(data[period:] != data[:-period])
        edges = np.concatenate([[-1], breaks, [max(0, len(data) - period)]])
        for i in np.flatnonzero(np.diff(edges) - 1 >= length).tolist():
            a, b = int(edges[i]) + 1, int(edges[i + 1]) + period
            if not any(x <= a and b <= y for x, y, _ in out):  # twice a period is none of its own
                out.append((a, b, period))
    return out


def anchors(data: np.ndarray, ends: np.ndarray, length: int, within: list[tuple[int, int, int]] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(places, identifiers) of the strings of Q bytes that are smallest in some string of `length` bytes of one text.

    Equal strings of `length` bytes hold their anchors at the same places, and each holds one. ends: where the texts in
    data end, in order, the first beginning at 0. Of the strings in a stretch of `within`, only those of the first period
    count, as all others equal one of them.
    """
    width = length - Q + 1
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ids = string_ids(data)
    least = _sliding(ids, width, np.minimum)
    end = np.repeat(ends, np.diff(ends, prepend=0))[: len(least)]
    least[np.arange(len(least)) + length > end] = 0
    for start, stop, period in within:
        least[max(0, start + period) : max(0, stop - length + 1)] = 0
    least = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    most = _sliding(least, width, np.maximum)
    at = np.flatnonzero(ids == most[: len(ids)])
    return at, ids[at]


def _text_anchors(texts: list[bytes], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
    """(text number, places, identifiers, periodic stretches) of the texts with anchors, short texts together, very long ones piece by piece.

    Texts in which anchors are dense, as strings repeat after a few bytes, are looked through again without what is periodic.
    """
    for i, at, ids in _all_anchors(texts, length):
        within = periodic(np.frombuffer(texts[i], np.uint8), length) if len(at) * DENSE_ANCHORS > len(texts[i]) else []
        if within:
            at, ids = _long_anchors(texts[i], length, within)
        yield i, at, ids, within


def _long_anchors(text: bytes, length: int, within: list[tuple[int, int, int]] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(places, identifiers) of the anchors of one text, piece by piece."""
    data, piece = np.frombuffer(text, np.uint8), 8 * GROUP_BYTES
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for a in range(0, len(data), piece):
        low, high = max(0, a - 2 * length), min(len(data), a + piece + 2 * length)
        at, ids = anchors(data[low:high], np.array([high - low]), length, [(x - low, y - low, p) for x, y, p in within])
        # Beside a cut, anchors of strings that the cut cuts are missing; those places belong to the next piece.
        own = (at + low >= a) & (at + low < a + piece)
        parts.append((at[own] + low, ids[own]))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _all_anchors(texts: list[bytes], length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    group: list[int] = []
    size = 0

    def hashed() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        data = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
        ends = np.cumsum([len(texts[i]) for i in group])
        at, ids = anchors(data, ends, length)
        cut = np.searchsorted(at, ends)
        first = start = 0
        for i, end, last in zip(group, ends.tolist(), cut.tolist(), strict=True):
            if last > first:
                yield i, at[first:last] - start, ids[first:last]
            first, start = last, end

    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        if len(text) > 16 * GROUP_BYTES:
            yield i, *_long_anchors(text, length)
            continue
        group.append(i)
        size += len(text)
        if size >= GROUP_BYTES:
            yield from hashed()
            group, size = [], 0
    if group:
        yield from hashed()


def _signed(h: int) -> int:
    return h - 2**63


def key_of(name, text: bytes) -> int:
    """Stands for a row: its id and its text."""
    return _signed(xxhash.xxh3_64_intdigest(f"{name}|".encode() + text))


def _first_pass(rows: DataFrame, length: int) -> DataFrame:
    """One row a document: its key, size, digest, the ranges of starts in periodic stretches, and anchors with the identifiers of all that the strings over them cover."""
    reach = length - Q
    lists = {"pos": pa.int32(), "h": pa.int64(), "u": pa.int64(), "lo": pa.int32(), "hi": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            texts = [t.as_py().encode() for t in batch.column(1)]
            found: list = [None] * len(texts)
            own: list = [[] for _ in texts]
            for i, at, ids, within in _text_anchors(texts, length):
                text, n = texts[i], len(texts[i])
                own[i] = [{"first": a, "last": b - length} for a, b, _ in within]
                low, high = np.maximum(0, at - reach), np.minimum(at, n - length)
                u = [_signed(xxhash.xxh3_64_intdigest(text[a : b + length], (p - a) * 65536 + b - a)) for p, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True)]
                found[i] = (at, ids.view(np.int64), np.array(u, np.int64), low - at + reach, high - at + reach)
            sizes = [len(f[0]) if f else 0 for f in found]
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            columns = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int64), *(f[c] for f in found if f)]).astype(kind.to_pandas_dtype()), kind)) for c, kind in enumerate(lists.values())]
            keys = [key_of(n, t) for n, t in zip(names, texts, strict=True)]
            digests = [hashlib.sha256(t).hexdigest() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array(digests), pa.array(own, stretches), *columns], ["doc_id", "k", "n_bytes", "sha", "own", *lists])

    stretches = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    kinds = "doc_id long, k long, n_bytes long, sha string, own array<struct<first:long,last:long>>, pos array<int>, h array<long>, u array<long>, lo array<int>, hi array<int>"
    return written(rows.mapInArrow(run, kinds), "anchors")


def _texts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, doc_id, text, compressed) of each row with a wanted key: a fixed-size filter first, so that few other texts reach the exact join."""

    size = FILTER_BITS[0]
    while size < FILTER_BITS[1] and size < 16 * wanted.count():
        size *= 2

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size, bool)
        for batch in batches:
            out[mixed(batch.column(0).to_numpy().view(np.uint64)) % np.uint64(size)] = True
        packed = np.packbits(out).reshape(64, -1)
        held = [i for i in range(64) if packed[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([packed[i].tobytes() for i in held], pa.binary())], ["block", "bits"])

    packed = np.zeros((64, size // 512), np.uint8)
    for row in wanted.select("k").coalesce(16).mapInArrow(bits, "block int, bits binary").toLocalIterator():
        packed[row["block"]] |= np.frombuffer(row["bits"], np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(packed.reshape(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [t.as_py().encode() for t in batch.column(1)]
            keys = np.array([key_of(n, t) for n, t in zip(batch.column(0).to_pylist(), texts, strict=True)], np.int64)
            at = mixed(keys.view(np.uint64)) % np.uint64(size)
            some = np.flatnonzero(sent.value[at >> np.uint64(3)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8) & 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys[some]), batch.column(0).take(pa.array(some)), pa.array([packer.compress(texts[i]) for i in some], pa.binary())], ["k", "doc_id", "text"])

    return rows.mapInArrow(run, "k long, doc_id long, text binary").join(wanted, "k")


def _contexts(rows: DataFrame, members: DataFrame, length: int) -> DataFrame:
    """The members (h, u, c, k, pos, lo, hi) with the bytes that the strings over their anchor cover."""
    reach = length - Q
    places = members.groupBy("k").agg(F.collect_list(F.struct("h", "u", "c", "pos", "lo", "hi")).alias("places"))
    found = _texts(rows, written(places, "places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            out, seen = [], set()
            for k, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k in seen:
                    continue
                seen.add(k)
                text = unpacker.decompress(text)
                for p in places:
                    start = p["pos"] - reach
                    out.append((p["h"], p["u"], p["c"], k, p["pos"], p["lo"], p["hi"], text[start + p["lo"] : start + p["hi"] + length]))
                if len(out) > 2000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = ["h", "u", "c", "k", "pos", "lo", "hi", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
    return found.select("k", "text", "places").mapInArrow(run, "h long, u long, c long, k long, pos int, lo int, hi int, bytes binary")


def ranked(*columns: np.ndarray) -> np.ndarray:
    """Sort on the columns; a number for each row, equal where all of them are."""
    out = np.unique(columns[0], return_inverse=True)[1].reshape(-1)
    for column in columns[1:]:
        own = np.unique(column, return_inverse=True)[1].reshape(-1)
        out = np.unique(out << 32 | own, return_inverse=True)[1].reshape(-1)
    return out


class Pointers:
    """Bucket pointers: for each row of bytes and each multiple of STEP, the buckets of the strings that start there.

    The first buckets are those of the strings of STEP bytes. Sorting on a place's bucket and the bucket that many bytes
    later gives the buckets of strings twice as long, which are sorted on in turn, up to LONGEST bytes.
    """

    def __init__(self, data: np.ndarray):
        self.words = data.view("<u8")
        shape = self.words.shape
        eight = ranked(self.words.reshape(-1)).reshape(shape)
        ids = ranked((eight[:, ::2] << 32 | eight[:, 1::2]).reshape(-1)).reshape(shape[0], -1)
        self.levels = [ids]
        ahead = 1
        while STEP * ahead < LONGEST:
            ids = ranked((ids[:, :-ahead] << 32 | ids[:, ahead:]).reshape(-1)).reshape(shape[0], -1)
            self.levels.append(ids)
            ahead *= 2

    def of(self, rows: np.ndarray, start: np.ndarray, stop: np.ndarray) -> list[np.ndarray]:
        """Columns that are equal where the bytes from start to stop are; both are multiples of STEP, all about as far apart."""
        short, wide = int((stop - start).min()) // STEP, int((stop - start).max()) // STEP
        level = min(len(self.levels) - 1, short.bit_length() - 1)
        many = 1 << level
        places = [np.minimum(start // STEP + i, stop // STEP - many) for i in range(0, wide - many + 1, many)]
        if (wide - many) % many:
            places.append(stop // STEP - many)
        return [self.levels[level][rows, p] for p in places]

    def word(self, rows: np.ndarray, place: int, low: int, high: int) -> np.ndarray | None:
        """The 8 bytes from the place, those before low and from high on as 0; None if that is all."""
        low, high = max(low, place), min(high, place + 8)
        if low >= high:
            return None
        mask = ((1 << 8 * (high - place)) - 1) & ~((1 << 8 * (low - place)) - 1)
        return self.words[rows, place // 8] & np.uint64(mask)


def finished(groups: np.ndarray, members: list[tuple[int, int, int, int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(k, first, last): ranges of starts of the single members whose strings another member of their group holds at the same place.

    members: (c, k, pos, lo, hi, bytes), group by group. A group is the first bucket. It is refined over ever narrower ranges
    of starts: the strings that start in a range share its core, so the members are sorted on the bucket pointers of the
    core's bytes, before and after the anchor. Members that agree in all that the range covers are repeats over the whole
    range, and one of them goes on for the others' sake; a bucket of one is done. At last, the few bytes that the strings
    from single starts hold beyond the core are sorted on.
    """
    reach = length - Q
    up = lambda x: -(-x // STEP) * STEP
    c, k, pos, lo, hi = (np.array(x, np.int64) for x in list(zip(*members, strict=True))[:5])
    data = np.zeros((len(members), up(reach + length) + 4 * STEP), np.uint8)
    for row, m in zip(data, members, strict=True):
        row[m[3] : m[3] + len(m[5])] = np.frombuffer(m[5], np.uint8)
    pointers = Pointers(data)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def refine(x: int, width: int, rows: np.ndarray, many: np.ndarray) -> None:
        y = min(x + width - 1, reach)
        first, last = np.maximum(x, lo[rows]), np.minimum(y, hi[rows])
        fine = first <= last
        rows, many, first, last = rows[fine], many[fine], first[fine], last[fine]
        if not len(rows):
            return
        core = np.array([up(y)]), np.array([(x + length) // STEP * STEP])
        columns = pointers.of(rows, *core) if core[1] > core[0] else []
        bucket = ranked(groups[rows], *columns)
        alone = np.bincount(bucket, many) < 2
        fine = ~alone[bucket]
        rows, many, first, last, bucket = rows[fine], many[fine], first[fine], last[fine], bucket[fine]
        if not len(rows):
            return
        kind = ranked(bucket, first << 32 | last, *pointers.of(rows, first // STEP * STEP, up(last + length)))
        copies = np.bincount(kind, many)
        hit = (copies[kind] > 1) & (c[rows] == 1)
        out.append((k[rows[hit]], pos[rows[hit]] - reach + first[hit], pos[rows[hit]] - reach + last[hit]))
        lead = np.unique(kind, return_index=True)[1]
        kinds = np.bincount(bucket[lead])
        lead = lead[kinds[bucket[lead]] > 1]
        if not len(lead):
            return
        rows, many, bucket = rows[lead], copies[kind[lead]], bucket[lead]
        if width > STEP:
            for part in range(x, min(x + width, reach + 1), width // 4):
                refine(part, width // 4, rows, many)
            return
        for start in range(x, y + 1):
            fine = (lo[rows] <= start) & (start <= hi[rows])
            own, stop = rows[fine], start + length
            words = [pointers.word(own, int(core[0][0]) - 16 + i, start, int(core[0][0])) for i in (0, 8)]
            words += [pointers.word(own, int(core[1][0]) + i, 0, stop) for i in (0, 8, 16, 24)]
            if not len(own):
                continue
            same = ranked(bucket[fine], *(w for w in words if w is not None))
            hit = (np.bincount(same, many[fine])[same] > 1) & (c[own] == 1)
            out.append((k[own[hit]], pos[own[hit]] - reach + start, pos[own[hit]] - reach + start))

    width = STEP
    while width < reach + 1:
        width *= 4
    refine(0, width, np.arange(len(members)), c.astype(np.float64))
    return tuple(np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def first_width(length: int) -> int:
    """Width of a range that holds all starts."""
    before = 512
    while before < length - Q + 1:
        before *= 8
    return before


def _finished(contexts: DataFrame, length: int) -> DataFrame:
    """The same for all buckets of (h, c, k, pos, lo, hi, bytes), some thousand members at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, groups = [], []

        def done() -> pa.RecordBatch:
            found = finished(np.repeat(np.arange(len(groups)), groups), held, length)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["k", "first", "last"])

        for _, members in runs(batches, 1):
            if len(members) > 1:
                held += members
                groups.append(len(members))
            if len(held) >= AT_ONCE:
                yield done()
                held, groups = [], []
        if held:
            yield done()

    rows = contexts.select("h", "c", "k", "pos", "lo", "hi", "bytes").repartition("h").sortWithinPartitions("h")
    return rows.mapInArrow(run, "k long, first long, last long")


def _refined(contexts: DataFrame, length: int) -> DataFrame:
    """(k, first, last): ranges of starts whose strings were found elsewhere, for the members that are single.

    A bucket holds the members whose strings over a range of starts agree in what all of them share. It is refined by
    halving the ranges: what the strings share then reaches further to either side, so a bucket splits by the identifiers
    of what lies at later and earlier places. A bucket of one has no repeats; in a bucket of several, members that agree
    in all that the range covers are repeats over the whole range, and one of them goes on for the others' sake.
    """
    reach = length - Q
    alive = contexts.select("h", "u", F.lit(0).alias("x"), F.col("c").alias("many"))
    before, out = first_width(length), None
    widths = [w for w in WIDTHS if w < before]
    for width in widths:

        def nodes(batches: Iterator[pa.RecordBatch], before=before, width=width) -> Iterator[pa.RecordBatch]:
            names = ["h", "u", "many", "c", "k", "pos", "x", "first", "last", "core", "all"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.int64(), pa.int64()]
            for batch in batches:
                rows = []
                for h, u, many, c, k, pos, x0, lo, hi, data in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                    for x in range(x0, min(x0 + before, reach + 1), width):
                        y = min(x + width - 1, reach)
                        first, last = max(x, lo), min(y, hi)
                        if first <= last:
                            core = xxhash.xxh3_64_intdigest(data[y - lo : x + length - lo])
                            whole = xxhash.xxh3_64_intdigest(data[first - lo : last + length - lo], (first - x) * 65536 + last - x)
                            rows.append((h, u, many, c, k, pos, x, first, last, _signed(core), _signed(whole)))
                    if len(rows) > 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        kept = alive.join(contexts, ["h", "u"]).select("h", "u", "many", "c", "k", "pos", "x", "lo", "hi", "bytes")
        made = kept.mapInArrow(nodes, "h long, u long, many long, c long, k long, pos int, x int, first int, last int, core long, `all` long")
        made = written(made, f"nodes{width}")
        same = written(made.groupBy("h", "x", "core", "all").agg(F.sum("many").alias("rows"), F.min("u").alias("lead")), f"same{width}")
        buckets = same.groupBy("h", "x", "core").agg(F.sum("rows").alias("bucket"), F.count("*").alias("kinds")).where("bucket > 1")
        buckets = written(buckets, f"buckets{width}")
        split = written(made.join(same, ["h", "x", "core", "all"]).join(buckets, ["h", "x", "core"]), f"split{width}")
        hits = split.where("c = 1 and rows > 1").select("k", (F.col("pos") - reach + F.col("first")).cast("long").alias("first"), (F.col("pos") - reach + F.col("last")).cast("long").alias("last"))
        out = hits if out is None else out.unionByName(hits)
        alive = split.where("kinds > 1 and (rows = 1 or u = lead)").select("h", "u", "x", F.col("rows").alias("many"))
        before = width
    return out


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of each row.

    A text is its UTF-8 bytes, null being empty. Every byte goes that a string of `length` bytes covers which starts at
    another place, too, in this or any other row; overlaps and rows that are equal count, strings never cross rows, and
    all is judged on the input. n_spans counts the maximal runs of removed bytes. with_text adds the bytes that stay, which
    may be cut within a character. An id may repeat or be null. No input: no rows.

    Identifiers of 64 bits stand for strings; two strings are taken for equal if those of their anchor and of all their
    bytes both agree.
    """
    if not 2 * Q <= length < 65536:
        raise ValueError(f"length must be from {2 * Q} to 65,535")
    reach = length - Q
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    passed = _first_pass(rows, length)
    each = passed.where(F.size("pos") > 0).select("k", F.explode(F.arrays_zip("pos", "h", "u", "lo", "hi")).alias("a")).select("k", "a.*")
    # A row's place in one number: the first row of an aggregate gives both columns.
    each = each.select("k", "h", "u", (F.col("pos").cast("long") * 2**32 + F.col("lo").cast("long") * 2**16 + F.col("hi")).alias("at"))
    # Most anchors stand once in the corpus; they go before anything wider is shuffled.
    repeated = written(each.groupBy("h").agg(F.count("*").alias("rows")).where("rows > 1").select("h"), "repeated")
    each = written(each.join(repeated, "h"), "rows")
    kinds = written(each.groupBy("h", "u").agg(F.count("*").alias("c"), F.first("k").alias("k"), F.first("at").alias("at")), "kinds")
    buckets = written(kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1"), "buckets")
    full = kinds.where("c > 1").select("h", "u")
    place = [F.expr("cast(at div 4294967296 as int)").alias("pos"), F.expr("cast(at div 65536 % 65536 as int)").alias("lo"), F.expr("cast(at % 65536 as int)").alias("hi")]
    members = kinds.join(buckets, "h").select("h", "u", "c", "k", *place, "kinds")
    members = written(members, "members")
    small = _finished(_contexts(rows, members.where(F.col("kinds") <= SMALL), length), length)
    large = members.where(F.col("kinds") > SMALL)
    found = small if large.isEmpty() else small.unionByName(_refined(written(_contexts(rows, large, length), "contexts"), length))

    whole = each.join(full, ["h", "u"]).select("k", *place).select("k", (F.col("pos") - reach + F.col("lo")).cast("long").alias("first"), (F.col("pos") - reach + F.col("hi")).cast("long").alias("last"))
    stretches = passed.where(F.size("own") > 0).select("k", F.explode("own").alias("s")).select("k", "s.first", "s.last")
    spans = whole.unionByName(found).unionByName(stretches).groupBy("k").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"))
    # Texts of which nothing stays need not be read again.
    sized = passed.select("k", "n_bytes").dropDuplicates(["k"])
    end = F.aggregate("spans", F.lit(0).cast("long"), lambda e, s: F.when((e >= 0) & (s["first"] <= e), F.greatest(e, s["last"] + length)).otherwise(F.lit(-1).cast("long")))
    spans = written(spans.join(sized, "k").withColumn("whole", end == F.col("n_bytes")).drop("n_bytes"), "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            sizes, removed, runs, digests, kept = [], [], [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = unpacker.decompress(text)
                parts, end, gone, count = [], 0, 0, 0
                for s in spans:
                    a, b = s["first"], s["last"] + length
                    if a > end or not count:
                        parts.append(text[end:a])
                        count += 1
                        gone += b - a
                        end = b
                    elif b > end:
                        gone += b - end
                        end = b
                parts.append(text[end:])
                rest = b"".join(parts)
                sizes.append(len(text))
                removed.append(gone)
                runs.append(count)
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (sizes, removed, runs)), pa.array(digests)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    extra = ", kept binary" if with_text else ""
    touched = _texts(rows, spans.where("not whole").select("k", "spans")).select("doc_id", "text", "spans").mapInArrow(cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string{extra}")
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    gone = passed.select("doc_id", "k", "n_bytes").join(spans.where("whole").select("k"), "k")
    kept = [F.lit("").cast("binary").alias("kept")] if with_text else []
    gone = gone.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), one.alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), *kept)
    touched = touched.unionByName(gone)
    rest = passed.select("doc_id", "k", "n_bytes", "sha").join(spans.select("k"), "k", "left_anti")
    if with_text:
        alone = rows.select("doc_id", F.col("text").cast("binary").alias("kept"), F.sha2("text", 256).alias("kept_sha256"))
        rest = alone.join(rest.select(F.col("doc_id").alias("_d"), F.col("sha").alias("kept_sha256"), "n_bytes").distinct(), "kept_sha256").where(F.col("doc_id").eqNullSafe(F.col("_d")))
        return touched.unionByName(rest.select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), "kept_sha256", "kept"))
    return touched.unionByName(rest.select("doc_id", "n_bytes", zero.alias("n_removed"), zero.alias("n_spans"), F.col("sha").alias("kept_sha256")))
