"""The pipeline's stages on rows with nulls, repeated ids, clashing columns and no rows at all, each against a plain version."""

import hashlib
import random

import pytest

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from . import brute as B  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _row string, taken int, Shard string, value string"
rng = random.Random(21)


def words(n):
    return " ".join(f"w{rng.randrange(3000):x}" for _ in range(n))


BASE = words(120)
NEAR = BASE.split()
NEAR[60] = "other"
KEY = "3f9a0c7be1d24586"
ROWS = [
    (1, BASE, "en", "a"), (2, " ".join(NEAR), "en", "b"), (3, BASE.upper(), None, None), (4, None, "en", "a"), (4, None, "en", "a"), (5, "", None, "b"), (6, " \t", "fr", "a"),
    (7, words(40), "en", "a"), (7, words(40), "en", "b"), (None, words(30), "fr", "c"), (None, None, None, None), (8, f'{words(20)} token = "{KEY}" {words(20)} {KEY}', "en", "c"), (9, words(4000), "fr", "c"),
    (10, "zażółć 日本語 🙂 " * 20, "xx", "d"), (11, "one two", "en", "d"), (11, "one two", "en", "d"),
]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t) if t else None, "clash", 1, "clash", "clash") for i, t, lang, s in rows], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return out


def key(rows):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"]) for r in rows), key=str)


def test_each_stage(spark, folder, tmp_path):
    docs, stages = table(spark, ROWS), dict(pipeline.STAGES)
    docs.write.parquet(f"{tmp_path}/0")
    docs = spark.read.parquet(f"{tmp_path}/0")
    # Nothing is trusted, so nothing is rejected.
    good = stages["quality classifier"](spark, docs, folder).collect()
    assert key(good) == sorted(ROWS, key=str)
    # One of each group of near duplicates: five words, 0.8. Texts without words stay.
    kept = stages["n-gram Jaccard join"](spark, docs, folder)
    assert kept.columns == docs.columns
    sets = [B.shingles(t, 5) for _, t, _, _ in ROWS]
    links = [(i, j) for i in range(len(ROWS)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    groups = B.groups(len(ROWS), links)
    got = key(kept.collect())
    assert all(r in ROWS for r in got)
    assert [r for r in got if not sets[ROWS.index(r)]] == sorted({r for i, r in enumerate(ROWS) if not sets[i]}, key=str)  # of equal rows one
    assert sorted(groups[ROWS.index(r)] for r in got if r[1] and r[1].strip()) == sorted({groups[i] for i, r in enumerate(ROWS) if r[1] and r[1].strip()})
    # Live secrets are replaced, wherever in the text they stand.
    hidden = stages["secret scans"](spark, docs, folder)
    assert hidden.columns == docs.columns
    assert key(hidden.collect()) == sorted([(i, t and t.replace(KEY, "[SECRET]"), lang, s) for i, t, lang, s in ROWS], key=str)
    assert all(r["n_chars"] == (len(r["text"]) if r["text"] else None) for r in hidden.collect())
    # Documents come whole, up to three times, or go; equal rows are taken alike.
    mixed = stages["mixing sources to target weights"](spark, docs, folder)
    assert mixed.columns == docs.columns
    times = {r: key(mixed.collect()).count(r) for r in set(ROWS)}
    assert sum(times.values()) == mixed.count()
    for r, n in times.items():
        assert n % ROWS.count(r) == 0 and n <= 3 * ROWS.count(r) and (n == 0 or B.WORD.findall(r[1] or ""))
    # The library's ids, and texts that come back.
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = stages["BPE encoding and decoding"](spark, docs, folder).collect()
    want = []
    for i, t, lang, s in ROWS:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, lang, s, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), B.sha(tokenizer.decode(ids, skip_special_tokens=False).encode())))
    assert sorted(((r["doc_id"], r["lang"], r["source"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out), key=str) == sorted(want, key=str)


def test_no_rows(spark, folder, tmp_path):
    docs = table(spark, [])
    for i, (_, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.schema(out.schema).parquet(f"{tmp_path}/{i}")
        assert docs.count() == 0
