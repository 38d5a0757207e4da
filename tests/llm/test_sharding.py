"""Sharding against a plain version of the shuffle, and the law that its shards keep."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

pytest.importorskip("public_tokenizers")
from spectrafold.llm import sharding  # noqa: E402

COLUMNS = "doc_id long, text string, shard string, Slot int, place double, c0 string, bytes long"
rng = random.Random(11)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 0.5, "y", 2) for i, t in rows], COLUMNS).repartition(3)


def rows_of(n):
    return [(i, " ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(30)))) for i in range(n)]


def law(got, rows, shards):
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"]) for r in got), key=str) == sorted(((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows), key=str)
    slots = defaultdict(list)
    for r in got:
        assert r["law"] == "rows" and r["grown_shard"] is None and 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    many = [len(slots[s]) for s in range(shards)]
    assert max(many) - min(many) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def hashed(seed, row, more=False):
    """Spark's chained hash of a seed and a row of (long, string) columns."""
    h = 42
    for v in (f"{seed}-2", *(v is None for v in row), *row) if more else (seed, *row):
        if v is None:
            continue
        data = v.encode() if isinstance(v, str) else int(v).to_bytes(4 if isinstance(v, bool) else 8, "little", signed=True)
        h = xxhash.xxh64_intdigest(data, h)
    return h - 2**64 if h >= 2**63 else h


def test_plain_version(spark):
    rows = [*rows_of(150), (None, None), (None, "a"), (500, None), (501, "é" * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    buckets = min(len(rows), sharding.BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = defaultdict(list)
    for r in rows:
        first = hashed("s", r)
        held[first % buckets].append((first, hashed("s", r, True), r))
    order = []
    for b in sorted(held):
        own = sorted(held[b], key=lambda x: x[:2])
        draws = np.random.default_rng([*b"s", b, 0]).integers(0, np.arange(1, len(own) + 1)).tolist()
        for i in range(len(own) - 1, 0, -1):
            own[i], own[draws[i]] = own[draws[i]], own[i]
        order += [r for _, _, r in own]
    small, more = divmod(len(rows), 24)
    places = [(s, n) for s in range(24) for n in range(small + (s < more))]
    wanted = {(*r, *p) for r, p in zip(order, places, strict=True)}
    got, shard, slot = sharding.placed(df, seed="s")
    assert {(r["doc_id"], r["text"], r[shard], r[slot]) for r in got.collect()} == wanted


@pytest.mark.parametrize("n", [0, 1, 7, 24, 25, 400])
def test_law(spark, n):
    rows = rows_of(n) + [(3, "same"), (3, "same"), (3, "other"), (None, None), (None, ""), (9, "x" * 5000)][: n and 6]
    law(sharding.report(frame(spark, rows)).collect(), rows, 24)


def test_same_result_however_the_input_is_dealt(spark):
    rows = rows_of(300)
    one, two = (sorted(map(tuple, sharding.report(frame(spark, rows).repartition(k)).collect())) for k in (2, 5))
    assert one == two
    other = sorted(map(tuple, sharding.report(frame(spark, rows), seed="another").collect()))
    assert one != other


def test_copies_of_one_row_are_dealt_on(spark):
    rows = [(1, "again " * 20)] * 900 + rows_of(300)
    df = frame(spark, rows)
    law(sharding.report(df, bucket_bytes=5_000).collect(), rows, 24)
    placed, place, count = sharding.shuffled(df, bucket_bytes=5_000)
    assert count == 1200 and sorted(r[place] for r in placed.select(place).collect()) == list(range(1200))


def test_files_hold_all_columns(spark, tmp_path):
    rows = rows_of(60)
    back, shard, slot = sharding.write_shards(frame(spark, rows), str(tmp_path / "out"), shards=5)
    assert shard.lower() not in {c.lower() for c in frame(spark, rows).columns} and slot not in frame(spark, rows).columns
    assert sorted((r["doc_id"], r["text"], r["c0"], r["place"]) for r in back.collect()) == sorted((i, t, "y", 0.5) for i, t in rows)
    assert sorted(p.name for p in (tmp_path / "out").glob(f"{shard}=*")) == [f"{shard}={i}" for i in range(5)]


def test_order_is_uniform(spark):
    """Where the first row of 40 comes to stand, over many seeds."""
    counts = Counter(int(sharding.fisher_yates(4, np.random.default_rng(s))[0]) for s in range(4000))
    assert all(850 < counts[i] < 1150 for i in range(4))
