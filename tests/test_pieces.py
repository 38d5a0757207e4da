"""Sequence files are read alike whole and in pieces, with and without headers."""

import gzip
import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from spectrafold.config import Config
from spectrafold.operators import kmers
from spectrafold.plans import runs
from spectrafold.sources import fasta

from .fixtures import FILES, counted, windows
from .fixtures import canonical as canonical_of

rng = random.Random(4)
LETTERS = "".join(rng.choice("ACGTN") for _ in range(9000))
MORE = {
    "bare.fa": "ACGTACGT\nTTTT\n>r1\nGGGG\n",
    "marked.fa": ">one > two\nACGTAC\n >three>four\r\nGGTT\r\n\n>\nAC\n",
    "long.fa": ">l\n" + "\n".join(LETTERS[i : i + 61] for i in range(0, 9000, 61)) + "\n>m\nAC\nGT\n>n\n" + "\n".join(LETTERS[:500]),
    "only headers.fa": ">a\n>b\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("pieces")
    for name, text in (FILES | MORE).items():
        (out / name).write_bytes(text.encode())
    return str(out)


def plain(text: str) -> list[str]:
    out = [""]
    for line in text.splitlines():
        line = "".join(line.split()).upper()
        if line.startswith(">"):
            out.append("")
        else:
            out[-1] += line
    return out


@pytest.mark.parametrize("boundary", ["file", "record"])
@pytest.mark.parametrize("k", [1, 4, 15, 33])
@pytest.mark.parametrize("split", [None, 200])
def test_counts(spark, folder, boundary, k, split):
    kept = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    if split:  # blocks of a few lines, so that many windows of 33 letters reach over their ends
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = {(r["sample"], r["feature"]): r["c"] for r in kmers.fasta_counts(spark, folder, Config(k=k, boundary=boundary)).collect()}
        pieces = fasta.read_pieces(spark, folder, k, boundary, size=50)
        small = {(r["sample"], r["feature"]): r["c"] for r in kmers.fast_counts(pieces, k).collect()}
        long = {r["sample"]: r["length"] for r in fasta.lengths(spark, folder).collect()}
    finally:
        for n, v in kept.items():
            spark.conf.set(n, v)
    expected = {}
    for name, text in (FILES | MORE).items():
        if name.endswith((".fa", ".fasta", ".fna", ".fas")):
            sample = name.rsplit(".", 1)[0]
            own = plain(text)
            for w, c in counted(own if boundary == "record" else ["".join(own)], k).items():
                expected[sample, w] = c
            assert long.get(sample, 0) == len("".join(own))
    assert got == expected == small
    whole = kmers.fast_counts(fasta.read_sequences(spark, folder, boundary), k)
    assert {(r["sample"], r["feature"]): r["c"] for r in whole.collect()} == expected


@pytest.mark.parametrize("boundary", ["file", "record"])
@pytest.mark.parametrize("split", [None, 200])
def test_all_lengths_in_one_scan(spark, folder, boundary, split):
    kept = {n: spark.conf.get(n) for n in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    if split:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    ks = [3, 14, 21, 33]
    try:
        for canonical in (False, True):
            small = fasta.read_pieces_for(spark, folder, ks, boundary, size=50)
            rows = kmers.fasta_grid_counts(spark, folder, ks, Config(boundary=boundary, canonical=canonical)).collect()
            assert sorted(map(tuple, rows)) == sorted(map(tuple, kmers.grid_counts(small, ks, canonical=canonical).collect()))
            expected = {}
            for name, text in (FILES | MORE).items():
                own = plain(text)
                for k in ks:
                    for w, c in counted(own if boundary == "record" else ["".join(own)], k, change=canonical_of if canonical else lambda w: w).items():
                        expected[k, name.rsplit(".", 1)[0], w] = c
            assert {(r["k"], r["sample"], r["feature"]): r["c"] for r in rows} == expected
    finally:
        for n, v in kept.items():
            spark.conf.set(n, v)


@pytest.mark.parametrize("packed", [False, True])
def test_short_records_share_a_piece(spark, tmp_path, packed):
    text = "".join(f">r{i}\nacgTN\n\nAC GT\u00e4{'T' * (i % 3)}\n" for i in range(1000)) + ">last\nACGTACGT"
    data = text.encode()
    (tmp_path / ("a.fa.gz" if packed else "a.fa")).write_bytes(gzip.compress(data) if packed else data)
    pieces = fasta.read_pieces_for(spark, str(tmp_path), [3, 5], "record")
    assert pieces.count() == 1
    got = {(r["k"], r["feature"]): r["c"] for r in kmers.grid_counts(pieces, [3, 5], validity="no_n").collect()}
    own = [r.replace("\u00c4", "?") for r in plain(text)]
    assert got == {(k, w): c for k in (3, 5) for w, c in counted(own, k, lambda w: "N" not in w).items()}
    # A gzipped file has no seams: it is read once.
    scans = re.findall("PushedFilters|EndsWith", pieces._jdf.queryExecution().executedPlan().toString())
    assert "EndsWith" in scans


def test_unknown_labels_are_not_scored(spark):
    pairs = spark.createDataFrame([("a", "b", 0.1), ("a", "c", 0.9), ("a", "d", 0.8), ("b", "c", 0.7), ("b", "d", 0.9), ("c", "d", -0.2)], "sample_i string, sample_j string, d double")
    counts = spark.createDataFrame([(s, f, 1) for s in "abcd" for f in "xy"], "sample string, feature string, c long")
    for last, unknown in (("two", False), ("unknown", True)):
        labels = spark.createDataFrame([("a", "one"), ("b", "one"), ("c", "two"), ("d", last)], "sample string, label string")
        scores = runs.scored(pairs, labels, Config()).collect()
        assert all((r["silhouette"] != r["silhouette"]) == unknown and (r["status"] == "not_computed") == unknown for r in scores)
        row = runs.overall_row(counts, pairs, labels, "kl", Config()).first()
        assert (row["silhouette"] != row["silhouette"]) == unknown and row["negative"] == 1
        assert unknown or row["named_silhouette"] == row["silhouette"] > 0.5


def test_short_sequences_are_counted_together():
    rows = [("ab"[i % 2], "ACGTA" * 3, 0, None) for i in range(1000)]
    kinds = pa.schema([("sample", pa.string()), ("sequence", pa.string()), ("seen", pa.int32()), ("only", pa.int32())])
    batch = pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], kinds)
    found = list(kmers.pieces(iter([batch]), [3, 5]))
    assert [(s, k) for s, k, _ in found] == [("a", 3), ("a", 5), ("b", 3), ("b", 5)]
    for validity in ("acgt", "no_n"):
        for _, k, piece in found:
            assert kmers.window_counts(piece, k, validity, False)[1].sum() == 500 * (15 - k + 1)


def test_short_sequences_are_joined_without_an_object_each(monkeypatch):
    monkeypatch.setattr(kmers, "PIECE", 100)
    texts = ["ACGTA", None, "", "AC\u00e4GT", "T" * 101, "G" * 100, "\U0001f600" * 99, *["ACG"] * 60]
    rows = [((None, "a", "b")[i % 3], t, 3 if i == 30 else 0, 2 if i == 40 else None) for i, t in enumerate(texts)]
    kinds = pa.schema([("sample", pa.string()), ("sequence", pa.string()), ("seen", pa.int32()), ("only", pa.int32())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in part], kinds) for part in (rows[:20], [], rows[20:])]
    calls = []
    monkeypatch.setattr(kmers, "joined", lambda s, q, own=kmers.joined: calls.append(len(q)) or own(s, q))
    got, expected = Counter(), Counter()
    for sample, k, piece in kmers.pieces(iter(batches), [2, 3]):
        assert len(piece) <= 202
        for w, c in zip(*kmers.window_counts(piece, k, "no_n", False), strict=True):
            got[sample, k, w.decode()] += int(c)
    for sample, t, seen, only in rows:
        for k in (2, 3):
            t = "".join(x if x < "\x80" else "?" for x in t or "")
            for w in windows(t[max(0, seen - k + 1) :], k) if only in (None, k) else []:
                expected[sample, k, w] += 1
    assert got == expected
    assert sum(calls) == len(rows) - 3 and len(calls) < 10
