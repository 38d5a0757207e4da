import gzip

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spectrafold.config import Config
from spectrafold.functions import sequence as S
from spectrafold.operators import kmers
from spectrafold.sources import fasta
from spectrafold.sources import labels as L

from .fixtures import FILES, canonical, counted


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("fasta")
    for name, text in FILES.items():
        (out / name).write_bytes(text.encode())
    with gzip.open(out / "zipped.fa.gz", "wt") as f:
        f.write(">z\nACGTACGT\n")
    (out / "notes.txt").write_text("ACGT")
    return str(out)


def test_sequences_by_file_and_record(spark, folder):
    files = {r["sample"]: r["sequence"] for r in fasta.read_sequences(spark, folder, "file").collect()}
    assert files["alpha.functional"] == "ACGTACGTACGTACGTNACG"
    assert files["beta.pathological"] == "ACGTACGTTTTTTACGRYACGT"
    assert files["gamma"] == "" and "delta" not in files
    assert files["zipped"] == "ACGTACGT"
    assert "notes" not in files
    records = sorted((r["sample"], r["sequence"]) for r in fasta.read_sequences(spark, folder, "record").collect())
    assert [s for n, s in records if n == "beta.pathological"] == ["ACGTACGTTT", "TTTACGRYACGT"]
    lines = fasta.read_lines(spark, folder).where("sample = 'beta.pathological'").orderBy("line_no").collect()
    assert [(r["record"], r["line"]) for r in lines] == [(1, "ACGTACGTTT"), (2, "TTTACGRYACGT")]
    assert {r["sample"]: r["header"] for r in fasta.headers(spark, folder).collect()} == {"alpha.functional": "a one", "beta.pathological": "b1", "gamma": "only a header", "short": "s", "zipped": "z"}


@pytest.mark.parametrize("k", [1, 3, 5, 33])
@pytest.mark.parametrize("boundary", ["file", "record"])
def test_counts_agree_with_plain_ones(spark, folder, k, boundary):
    config = Config(k=k, boundary=boundary)
    rows = kmers.fasta_counts(spark, folder, config).collect()
    sequences = fasta.read_sequences(spark, folder, boundary)
    native = kmers.native_counts(sequences, k).collect()
    by = {}
    for r in sequences.collect():
        by.setdefault(r["sample"], []).append(r["sequence"])
    expected = {(s, w, c) for s, q in by.items() for w, c in counted(q, k).items()}
    assert {tuple(r) for r in rows} == expected == {(r["sample"], r["feature"], r["c"]) for r in native}


def test_validity_and_strand(spark, folder):
    sequences = fasta.read_sequences(spark, folder)
    by = {r["sample"]: [r["sequence"]] for r in sequences.collect()}
    for options, keep, change in (
        ({"validity": "no_n"}, lambda w: "N" not in w, lambda w: w),
        ({"canonical": True}, lambda w: set(w) <= set("ACGT"), canonical),
    ):
        expected = {(s, w, c) for s, q in by.items() for w, c in counted(q, 4, keep, change).items()}
        for f in (kmers.fast_counts, kmers.native_counts):
            assert {(r["sample"], r["feature"], r["c"]) for r in f(sequences, 4, **options).collect()} == expected
    beyond = {(r["sample"], r["feature"]) for r in kmers.fast_counts(sequences, 35, canonical=True).collect()}
    assert not beyond


def test_pieces_overlap(monkeypatch):
    monkeypatch.setattr(kmers, "PIECE", 7)
    text = "ACGTTGCATGACCTGAAC"
    for seen in (0, 3, 9):
        found = [p.decode() for _, p in kmers.pieces_of(("s", pa.scalar(text), seen, None), [4])]
        assert sum((counted([p], 4) for p in found), start=counted([], 4)) == counted([text[max(0, seen - 3) :]], 4)
    assert not list(kmers.pieces_of(("s", pa.scalar(text), 0, 5), [4]))


def test_line_blocks_hold_every_window(spark):
    lines = spark.createDataFrame([("s", 1, 0, "ACGTA"), ("s", 1, 1, "C"), ("s", 1, 2, "GT"), ("s", 1, 3, "TTACG"), ("s", 2, 4, "AAAA")], "sample string, record int, line_no int, line string")
    rows = kmers.native_counts(kmers.line_blocks(lines, 4).select("sample", F.col("block").alias("sequence")), 4).collect()
    assert {r["feature"]: r["c"] for r in rows} == dict(counted(["ACGTACGTTTACG", "AAAA"], 4))


def test_codes_and_names(spark):
    rows = spark.createDataFrame([("ACGT",), ("TTTT",), ("ACNT",)], "k string").select(S.two_bit(F.col("k")), S.canonical(F.col("k"))).collect()
    assert [tuple(r) for r in rows] == [(27, "ACGT"), (255, "AAAA"), (-1, "ACNT")]
    names = spark.createDataFrame([("/x y/Sample.FASTA.gz",), ("b.fna",), ("c.fa.txt",)], "n string").select(S.sample_name(F.col("n"))).collect()
    assert [r[0] for r in names] == ["Sample", "b", "c.fa.txt"]
    order = spark.createDataFrame([("s10",), ("s9",), ("s1b",), ("s1a20",), ("s1a3",)], "n string")
    assert [r[0] for r in order.orderBy(*S.natural_key(F.col("n"))).collect()] == ["s1a3", "s1a20", "s1b", "s9", "s10"]
    assert S.tag(1e-06) == "1em06" and S.tag(0.001) == "0p001"


def test_label_rules(spark):
    rows = spark.createDataFrame([("x.Functional",), ("PATHOGENIC",), ("sample07",), ("sample03",), ("suis_abortus",), ("zzz",)], "n string")
    n = F.col("n")
    got = rows.select(L.by_class_name(n), L.by_class_code(n), L.by_number(n), L.by_species(n)).collect()
    assert [tuple(r) for r in got] == [
        ("functional", 0, "functional", "Brucella_sp"), ("pathological", 1, "pathological", "Brucella_sp"), ("unknown", -1, "pathological", "Brucella_sp"),
        ("unknown", -1, "functional", "Brucella_sp"), ("unknown", -1, "unknown", "abortus"), ("unknown", -1, "unknown", "Brucella_sp"),
    ]
    heads = spark.createDataFrame([("X1 Brucella sp. 83 chr",), ("X1 Brucella suis 1330",), ("X1",)], "h string").select(L.by_header(F.col("h"))).collect()
    assert [r[0] for r in heads] == ["Brucella sp. 83", "Brucella suis", "Unknown Brucella"]
    assert spark.createDataFrame([("GCA_1.1_rest_x",)], "n string").select(L.accession(F.col("n"))).first()[0] == "GCA_1.1"


def test_label_tables(spark):
    samples = spark.createDataFrame([("a",), ("b",)], "sample string")
    table = spark.createDataFrame([(" a ", "g1", "1"), ("b", "g2", "2"), ("c", "g3", "3")], "sample string, group string, group_id string")
    got, extra = L.strict(samples, table)
    assert {(r["sample"], r["label"]) for r in got.collect()} == {("a", "g1"), ("b", "g2")} and extra == ["c"]
    with pytest.raises(ValueError, match="without a label: d"):
        L.strict(spark.createDataFrame([("d",)], "sample string"), table)
    with pytest.raises(ValueError, match="two labels: a"):
        L.strict(samples, table.union(table.where("group_id = '1'")))
    with pytest.raises(ValueError, match="no column species"):
        L.strict(samples, table, label_col="species")
    other = spark.createDataFrame([("A.fa", "x"), ("b.fasta", None)], "File string, Class string")
    loose = {r["sample"]: r["label"] for r in L.lenient(samples, other).collect()}
    assert loose == {"a": "x", "b": "unknown"}
    with pytest.raises(ValueError, match="without a label"):
        L.flexible(samples, other, "Class")
    assert {r["group_id"] for r in L.grouped(samples, table).collect()} == {1, 2}
    named = L.by_accession(spark.createDataFrame([("G_1_x",)], "sample string"), spark.createDataFrame([("G_1", 4, "q")], "accession string, group_id int, group string"))
    assert named.first()["group"] == "q"
