import pytest

from spectrafold import __main__ as cli
from spectrafold.operators import kmers
from spectrafold.plans import runs, sinks

from . import fixtures as X


def test_a_grid_from_the_command_line(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    texts = {"sample01": "ACGTTGCAACGTGACC", "sample02": "ACGTTGCAACGTGACG", "sample06": "GGGTTTACCGGTACCA", "sample07": "GGGTTTACCGGTACCT"}
    for name, text in texts.items():
        (folder / f"{name}.fa").write_text(f">{name}\n{text}\n")
    args = cli.parser().parse_args(["kl", str(folder), "--out", str(tmp_path / "out"), "--k", "2", "3", "--alpha", "0.5", "1"])
    rows = {(r["k"], r["alpha"]): r["silhouette"] for r in cli.run(spark, args).collect()}
    assert set(rows) == {(2, 0.5), (2, 1.0), (3, 0.5), (3, 1.0)}
    for (k, alpha), score in rows.items():
        names, c = X.dense({n: X.counted([t], k) for n, t in texts.items()})
        d = X.symmetric_kl(X.smoothed(c, alpha))
        own = X.silhouettes(d, ["functional", "functional", "pathological", "pathological"])
        assert abs(score - sum(own) / 4) < 1e-9
    best = spark.read.csv(str(tmp_path / "out" / "best"), header=True).first()
    assert abs(float(best["silhouette"]) - max(rows.values())) < 1e-9
    assert spark.read.csv(str(tmp_path / "out" / "samples-0"), header=True).count() == 4


def sequences(folder, **texts):
    folder.mkdir(exist_ok=True)
    for name, text in texts.items():
        (folder / f"{name}.fa").write_text(f">{name}\n{text}\n")


FOUR = {"sample01": "ACGTTGCAACGTGACC", "sample02": "ACGTTGCAACGTGACG", "sample06": "GGGTTTACCGGTACCA", "sample07": "GGGTTTACCGGTACCT"}


def score(texts, k, alpha):
    _, c = X.dense({n: X.counted([t], k) for n, t in sorted(texts.items())})
    return sum(X.silhouettes(X.symmetric_kl(X.smoothed(c, alpha)), ["functional", "functional", "pathological", "pathological"])) / 4


def test_counts_are_reused_only_for_the_same_files(spark, tmp_path, monkeypatch):
    folder, cache, summary = tmp_path / "in", str(tmp_path / "cache"), str(tmp_path / "summary")
    made = []
    real = kmers.fasta_grid_counts
    monkeypatch.setattr(kmers, "fasta_grid_counts", lambda *a: made.append(a[2]) or real(*a))

    def overall(*more):
        args = cli.parser().parse_args(["kl", str(folder), "--out", str(tmp_path / "out"), "--cache", cache, "--k", "2", "3", "--summary", summary, *more])
        return {r["k"]: r["silhouette"] for r in cli.run(spark, args).collect()}

    sequences(folder, **FOUR)
    first = overall()
    assert made == [[2, 3]] and all(abs(first[k] - score(FOUR, k, 1.0)) < 1e-9 for k in (2, 3))  # one scan for both k
    assert overall("--reuse") == first and made == [[2, 3]]
    other = FOUR | {"sample02": "TTTTTTTTTTTTTTTTGACG"}
    sequences(folder, **other)
    second = overall("--reuse")  # neither counts nor pairs of the old files
    assert made == [[2, 3]] * 2 and all(abs(second[k] - score(other, k, 1.0)) < 1e-9 for k in (2, 3)) and second != first
    elsewhere = tmp_path / "elsewhere"
    sequences(elsewhere, **FOUR)
    folder = elsewhere
    assert overall() == first and len(made) == 3
    rows = sinks.read_upserted(spark, summary).collect()
    assert sorted((r["path"], r["k"], r["silhouette"]) for r in rows) == sorted([(str(tmp_path / "in"), k, second[k]) for k in (2, 3)] + [(str(elsewhere), k, first[k]) for k in (2, 3)])


def test_pairs_are_reused(spark, tmp_path, monkeypatch):
    sequences(tmp_path / "in", **FOUR)
    args = ["kl", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--k", "3"]
    first = cli.run(spark, cli.parser().parse_args(args)).first()
    monkeypatch.setattr(runs, "pairs", lambda *a: pytest.fail("made again"))
    assert cli.run(spark, cli.parser().parse_args([*args, "--reuse"])).first() == first
    with pytest.raises(pytest.fail.Exception):
        cli.run(spark, cli.parser().parse_args([*args, "--reuse", "--alpha", "2"]))


def test_a_sample_without_kmers_is_an_error(spark, tmp_path):
    sequences(tmp_path / "in", **FOUR, sample03="AC", sample08="")
    args = ["kl", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--k", "3"]
    with pytest.raises(ValueError, match="samples without counts, among them sample03, sample08"):
        cli.run(spark, cli.parser().parse_args(args))
    row = cli.run(spark, cli.parser().parse_args([*args, "--skip-empty"])).first()
    assert abs(row["silhouette"] - score(FOUR, 3, 1.0)) < 1e-9


def test_options():
    args = cli.parser().parse_args(["kwip", "x", "--out", "y", "--no-canonical"])
    assert [c.canonical for c in cli.configs(args)] == [False]
    assert [c.canonical for c in cli.configs(cli.parser().parse_args(["kwip", "x", "--out", "y"]))] == [True]
    args = cli.parser().parse_args(["kl", "x", "--out", "y", "--weight", "inverse", "--beta", "1", "2", "--cap-weight", "5"])
    assert [(c.beta, c.cap_weight) for c in cli.configs(args)] == [(1.0, 5.0), (2.0, 5.0)]
    with pytest.raises(ValueError):
        cli.configs(cli.parser().parse_args(["kl", "x", "--out", "y", "--weight", "inverse"]))


def test_matrix_makes_its_pairs_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    pairs = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 3.0)], "sample_i string, sample_j string, d double").mapInArrow(run, "sample_i string, sample_j string, d double")
    sinks.write_matrix(pairs, f"{tmp_path}/m", "%.1f")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/m").collect()] == ["0.0 1.0 2.0", "1.0 0.0 3.0", "2.0 3.0 0.0"]
    assert made.value == 3
