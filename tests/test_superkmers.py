"""Super-k-mers: packing, buckets, and what they take to shuffle."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrafold.operators import kmers
from spectrafold.operators import superkmers as S

from .fixtures import canonical, counted

rng = random.Random(6)


@pytest.mark.parametrize("k", [13, 20, 31])
@pytest.mark.parametrize("strands", [False, True])
def test_packing(k, strands):
    for text in ("", "ACGT", "A" * 300, "".join(rng.choice("ACGTACGTACGTN") for _ in range(3000)), "".join(rng.choice("ACGT") for _ in range(997))):
        found, where = [], {}
        for bucket, lengths, bases in S.packed(text.encode(), k, 64, strands):
            own = [w.decode() for w in S.spelled(S.unpacked(lengths, bases, k, strands), k)]
            found += own
            for w in own:
                assert where.setdefault(w, bucket) == bucket  # a k-mer has one bucket wherever it stands
        assert sorted(found) == sorted(counted([text], k, change=canonical if strands else lambda w: w).elements())


def test_minimisers_are_the_least_of_their_window():
    digits = np.array([rng.randrange(4) for _ in range(400)], np.uint8)
    for k in (9, 10, 13, 31):
        each = S.minimisers(digits, S.MINIMISER, False)
        assert np.array_equal(S.minimisers(digits, k, False), [each[i : i + k - S.MINIMISER + 1].min() for i in range(400 - k + 1)])
    back = S.minimisers(3 - digits[::-1], 21, True)[::-1]
    assert np.array_equal(S.minimisers(digits, 21, True), back)


def bytes_of(df) -> int:
    """Bytes of all values, 8 for a number."""
    wide = [F.octet_length(c) if kind in ("string", "binary") else F.lit(8) for c, kind in df.dtypes]
    return df.select(F.sum(sum(wide, F.lit(0)))).first()[0]


def test_little_is_shuffled(spark):
    rows = [(f"s{i % 3}", "".join(rng.choice("ACGT") for _ in range(30_000))) for i in range(6)]
    sequences = spark.createDataFrame(rows, "sample string, sequence string").withColumns({"seen": F.lit(0), "only": F.lit(None).cast("int")})
    packed = S.shuffled(sequences, [31], True)
    plain = kmers.fast_counts(sequences.select("sample", "sequence"), 31, canonical=True)
    assert 5 * bytes_of(packed) <= bytes_of(plain)  # of partial counts there are as many rows at least
    got = {(r["sample"], r["feature"]): r["c"] for r in plain.collect()}
    assert got == {(s, w): c for s in ("s0", "s1", "s2") for w, c in counted([t for n, t in rows if n == s], 31, change=canonical).items()}


def test_buckets_are_sorted_in_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "SORTED", 50)
    text = "".join(rng.choice("ACGT") for _ in range(2000))
    sequences = spark.createDataFrame([("a", text), ("a", text), ("b", text[:500]), ("c", None), ("d", "ACG")], "sample string, sequence string")
    got = {(r["k"], r["sample"], r["feature"]): r["c"] for r in kmers.grid_counts(sequences, [13, 17]).collect()}
    assert got == {(k, n, w): c for k in (13, 17) for n, own in (("a", [text, text]), ("b", [text[:500]])) for w, c in counted(own, k).items()}
