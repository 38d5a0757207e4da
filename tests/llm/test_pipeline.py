import os

import pytest

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_stages_follow_each_other(spark, tmp_path):
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "BPE encoding and decoding"]
    docs = first = spark.read.parquet(f"{DATA}/documents.parquet")
    quality = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for i, (_, stage) in enumerate(pipeline.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after <= before
        if i < 4:
            assert sorted(docs.columns) == sorted(first.columns)
        if i == 0:
            assert all(i in after for i, r in quality.items() if r["quality"] == 1 and r["toxic"] == 0)
    assert docs.count() > 50 and {"n_tokens", "ids_sha256", "decoded_sha256", "ids"} <= set(docs.columns)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in pipeline.run(spark, DATA).collect()) == sorted((r["doc_id"], r["ids_sha256"]) for r in docs.collect())


def test_the_library_stands_alone():
    import subprocess
    import sys

    code = "import sys, spectrafold.queries as q; assert not [m for m in sys.modules if m.startswith('spectrafold.llm')]"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
