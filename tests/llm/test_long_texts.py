"""Very long runs of one character, and joins of chunks, against the tokenizers library."""

import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from spectrafold.llm import bpe, token_store  # noqa: E402

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
MANY = 2_000_000


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def ids(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)


@pytest.mark.parametrize("run", [" ", "\t", "\n", "\r", "\x0b", "\x0c", "\x85", "\xa0", " \n", "a", "!", "é"])
def test_long_runs(library, run):
    encoder = bpe.ChunkEncoder(bpe.vocabulary(TOKENIZER))
    long = run * (MANY // len(run))
    text = "some words " + long + " and more"
    assert np.array_equal(encoder.encode(text), ids(library, text))
    for text in (long[:200_000], long[:200_000] + "x", "word " + long[:200_000]):
        assert np.array_equal(encoder.encode(text), ids(library, text))


def test_joins(library, monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(bpe, "CHUNK_BITS", 4)
    monkeypatch.setattr(bpe, "LEAST_CHUNK", 16)
    encoder = bpe.ChunkEncoder(bpe.vocabulary(TOKENIZER))
    pieces = ["the", "  ", "\n", "don't", " 12345", "é日本", "<|endoftext|>", "!!", "word", " ", "\t x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", " ", "a b c d e f g h"]
    for _ in range(400):
        text = "".join(rng.choice(pieces) + rng.choice(["", " ", " ", " the"]) for _ in range(rng.randrange(1, 120)))
        assert np.array_equal(encoder.encode(text), ids(library, text)), text
    assert encoder.reused > 100


def test_long_runs_in_the_queries(spark, library):
    texts = [" " * MANY + "x", "a" + " \n" * (MANY // 2)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in bpe.encoded(docs, TOKENIZER).collect():
        assert r["n_tokens"] == len(ids(library, texts[r["doc_id"]]))
    stored = {r["doc_id"]: r["n_tokens"] for r in token_store.store(docs, TOKENIZER).select("doc_id", F.col("n_tokens")).collect()}
    assert stored == {i: len(ids(library, t)) + 1 for i, t in enumerate(texts)}
