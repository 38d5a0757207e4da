"""The jobs: runs over growing input, reruns, settings and the command line."""

import json
import os
import subprocess
import sys

import numpy as np
import pytest

from jobs import common, compare_samples, grow_profiles
from jobs import queries as Q

from . import fixtures as X

COLUMNS = "doc_id long, text string, lang string, source string"
CONFIG = {"text": "text", "sample": ["lang", "source"], "label": "lang", "k": 2, "pattern": "^[a-c]{2}$", "files_at_once": 2, "runs": [{"method": "kl", "alpha": 0.5}, {"method": "jsd"}]}
ROWS = [(1, "abcabcab", "en", "s"), (2, "aabbccx", "en", "t"), (3, None, "en", "s"), (4, "cab-bac", "fr", None), (5, "", "fr", "t"), (6, "ccccc", "fr", "s"), (6, "ccccc", "fr", "s"), (7, "A", None, "s"), (8, "bca" * 50, None, "s")]


def write(spark, rows, path, mode="append"):
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode(mode).parquet(path)


def plain(rows):
    texts = {}
    for _, text, *names in rows:
        texts.setdefault("|".join(n or "?" for n in names), []).append(text or "")
    out = {s: X.counted(t, 2, lambda w: set(w) <= set("abc")) for s, t in texts.items()}
    return {s: c for s, c in out.items() if c}


def counts(spark, out):
    return {(r["sample"], r["feature"]): r["c"] for r in spark.read.parquet(f"{out}/counts").collect()}


def wanted(rows):
    return {(s, w): c for s, own in plain(rows).items() for w, c in own.items()}


def test_profiles_grow_with_the_input(spark, tmp_path):
    docs, out, state = (str(tmp_path / n) for n in ("docs", "out", "state"))
    setting = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    for rows in (ROWS[:3], ROWS[3:5]):
        write(spark, rows, docs)
    first = grow_profiles.grow(spark, docs, out, state, CONFIG)
    assert first["documents read"] == 5 and counts(spark, out) == wanted(ROWS[:5])
    for rows in (ROWS[5:6], ROWS[6:7], ROWS[7:]):
        write(spark, rows, docs)
    second = grow_profiles.grow(spark, docs, out, state, CONFIG)
    assert second == {"batches": 2, "documents read": 4, "counts written": len(wanted(ROWS))}  # two files at once
    assert counts(spark, out) == wanted(ROWS)
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")}
    assert grow_profiles.grow(spark, docs, out, state, CONFIG) == {"batches": 0, "documents read": 0, "counts written": 0}
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "out").rglob("*.parquet")} == files
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == setting


def test_a_batch_that_was_cut_short_is_taken_again(spark, tmp_path, monkeypatch):
    docs, out, state = (str(tmp_path / n) for n in ("docs", "out", "state"))
    write(spark, ROWS[:4], docs)
    real = common.replace_partitions

    def fails(rows, path, by):
        real(rows, path, by)
        raise RuntimeError("lost after the write")

    monkeypatch.setattr(common, "replace_partitions", fails)
    with pytest.raises(Exception, match="lost after the write"):
        grow_profiles.grow(spark, docs, out, state, CONFIG)
    monkeypatch.setattr(common, "replace_partitions", real)
    write(spark, ROWS[4:], docs)
    grow_profiles.grow(spark, docs, out, state, CONFIG)
    assert counts(spark, out) == wanted(ROWS)


def test_a_table_of_one_file(spark, tmp_path):
    write(spark, ROWS, str(tmp_path / "docs"))
    (file,) = (tmp_path / "docs").glob("*.parquet")
    (tmp_path / "in").mkdir()
    file.rename(tmp_path / "in" / "documents.parquet")
    write(spark, ROWS, str(tmp_path / "in" / "other.parquet"))
    grow_profiles.grow(spark, str(tmp_path / "in" / "documents.parquet"), str(tmp_path / "out"), str(tmp_path / "state"), CONFIG)
    assert counts(spark, str(tmp_path / "out")) == wanted(ROWS)


def test_comparison(spark, tmp_path):
    docs, out = str(tmp_path / "docs"), str(tmp_path / "out")
    write(spark, ROWS, docs)
    first = compare_samples.compare(spark, docs, out, CONFIG)
    own = plain(ROWS)
    names, c = X.dense(own)
    for run, d in (("kl-alpha_0p5", X.symmetric_kl(X.smoothed(c, 0.5))), ("jsd", np.sqrt(np.maximum(0, X.jensen_shannon(c / c.sum(1, keepdims=True)))))):
        score = {r["sample"]: r for r in spark.read.parquet(f"{out}/scores").where(f"run = '{run}'").collect()}
        labels = [n.split("|")[0] for n in names]
        assert sorted(score) == names and [score[n]["label"] for n in names] == labels
        for i, (n, s) in enumerate(zip(names, X.silhouettes(d, labels), strict=True)):
            assert abs(score[n]["silhouette"] - s) < 1e-9 and abs(score[n]["nearest"] - min(np.delete(d[i], i))) < 1e-9
    before = sorted(map(tuple, spark.read.parquet(f"{out}/scores").collect()))
    assert compare_samples.compare(spark, docs, out, CONFIG) == first
    assert sorted(map(tuple, spark.read.parquet(f"{out}/scores").collect())) == before
    # Other runs come beside those that are there.
    compare_samples.compare(spark, docs, out, CONFIG | {"runs": [{"method": "cosine"}]})
    after = spark.read.parquet(f"{out}/scores")
    assert {r["run"] for r in after.select("run").distinct().collect()} == {"kl-alpha_0p5", "jsd", "cosine"}
    assert sorted(map(tuple, after.where("run != 'cosine'").collect())) == before


def test_two_labels_of_a_sample_are_refused(spark, tmp_path):
    write(spark, ROWS, str(tmp_path / "docs"))
    with pytest.raises(ValueError, match="more than one value"):
        compare_samples.compare(spark, str(tmp_path / "docs"), str(tmp_path / "out"), CONFIG | {"sample": ["source"]})


@pytest.mark.parametrize("method", sorted({r["method"] for r in Q.COMPARE["runs"]}))
def test_shipped_settings(method):
    assert all(compare_samples.config_of(r).alpha == r.get("alpha", compare_samples.config_of({"method": method}).alpha) for r in Q.COMPARE["runs"] if r["method"] == method)


def test_command_line(spark, tmp_path):
    """In a process of its own, as it starts and stops a session."""
    write(spark, ROWS, str(tmp_path / "docs"))
    (tmp_path / "c.json").write_text(json.dumps(CONFIG))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    args = [sys.executable, "-m", "jobs.grow_profiles", "--documents", tmp_path / "docs", "--out", tmp_path / "out", "--checkpoint", tmp_path / "state", "--config", tmp_path / "c.json"]
    said = subprocess.run(list(map(str, args)), cwd=root, env=os.environ | {"SPARK_LOCAL_IP": "127.0.0.1"}, capture_output=True, text=True, timeout=300, check=True)
    assert "read 9 new documents" in said.stderr and counts(spark, str(tmp_path / "out")) == wanted(ROWS)
