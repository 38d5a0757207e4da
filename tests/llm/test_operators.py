import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from spectrafold.llm import ann, bpe, common, embed_dedup, jaccard, mixing, pii, quality, secret_scan, suffix_dedup, token_store  # noqa: E402

from . import brute as B  # noqa: E402

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row int, size string, _text string"
rng = random.Random(5)


def words(n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary):x}" for _ in range(n))


LONG = words(3000)
PASSAGE = words(160)
BASE = words(120)
EDITED = BASE.split()
EDITED[60] = "edited"
TEXTS = [
    (1, None), (2, ""), (3, " \t\n"), (4, "One"), (5, "one"), (6, BASE), (7, BASE), (8, BASE.upper()), (9, " ".join(EDITED)), (10, LONG), (11, words(40) + " " + PASSAGE + " " + words(30)),
    (12, PASSAGE + "\n" + words(20)), (13, words(25) + PASSAGE[:700]), (14, "ab" * 700), (15, "a" * 900), (16, "zażółć gęślą 日本語 " * 60 + "🙂" * 9), (17, BASE + " " + words(8)), (18, "two words"),
    (19, "x <|endoftext|> y\x85\xa0z  \r\n\x1c end"), (20, LONG[:9000] + "é" + LONG[9001:]), (21, "four little words here"), (22, "Four little words here"),
    (23, f'password = "{"k3yV4lue" * 2}" AKIA{"ABCD1234" * 2} {"0123456789abcdef" * 2} token:short secret: token: longenough1 api_key=x api-key=12345678 PassWD:\'Zz99zz99Zz'),
    (24, "mail me.x+y@a-b.example.co or @nobody a@b 10.2.3.255.7 999.1.1.1 4111 1111 1111 1111 4111111111111112 +1 (415) 555-2671 +12 3 1.2.3.4 x@y.z@q.w"),
]


def docs(spark, rows=None, extra=True):
    rows = TEXTS if rows is None else rows
    full = [(i, t, [None, "en", "fr"][i % 3] if i is not None else "en", [None, "", "a", "Z", "é"][i % 5] if i is not None else "a", len(t or ""), 7, "s", "clash") for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def empty(spark):
    return docs(spark, [])


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 200), (5, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(df).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert common.components(df.limit(0)).count() == 0


def test_mix(spark):
    rows = [(i, words(rng.randrange(0, 60))) for i in range(300)] + [(7, words(5))] * 3 + [(1000, words(4000)), (1001, None)]
    df = docs(spark, rows)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and got == [*got]
    sizes = {}
    for r in df.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(B.WORD.findall(r["text"] or ""))
    aim = B.targets(sizes)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], aim[r["source"]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert math.isclose(sum(aim.values()), sum(sizes.values()))
    for s, n in taken.items():
        assert abs(n - aim[s]) <= max(8, 0.02 * aim[s])
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted((r["doc_id"], r["size"], r["taken"]) for r in again) == sorted((r["doc_id"], r["size"], r["taken"]) for r in got)
    assert mixing.mix(empty(spark)).count() == 0
    assert [r["taken"] for r in mixing.mix(docs(spark, [(1, None), (2, " ")])).collect()] == [0, 0]
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.where("text is null").count() == 0 and mixed.count() > 100


def test_apportion_is_highest_quotients(spark):
    cases = {1: ([5, 5, 5], 7), 2: ([100, 1, 1, 0], 10), 3: ([3], 4), 4: ([0, 0], 3), 5: ([7, 7, 2, 9, 30], 23), 6: ([2, 3], 0)}
    rows = [(g, i, float(w), m) for g, (ws, m) in cases.items() for i, w in enumerate(ws)]
    got = mixing.apportion(spark.createDataFrame(rows, "g int, child int, w double, m long"), ["g"], "child", "w", "m", "won").collect()
    for g, (ws, m) in cases.items():
        won = [0] * len(ws)
        for _ in range(m if sum(ws) else 0):
            won[max(range(len(ws)), key=lambda i: (ws[i] / (2 * won[i] + 1), -i))] += 1
        assert [r["won"] for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["child"])] == won


@pytest.mark.parametrize("small", [4096, 1])
def test_repeats(spark, monkeypatch, small):
    monkeypatch.setattr(suffix_dedup, "SMALL", small)
    rows = [*TEXTS, (7, BASE), (None, BASE), (30, PASSAGE[30:] + PASSAGE[:200])]
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs(spark, rows)).collect())
    assert got == sorted((str(i), *x) for (i, _), x in zip(rows, B.repeats([t for _, t in rows], 400), strict=True))
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0
    kept = suffix_dedup.remove_repeats(docs(spark, rows), with_text=True).collect()
    assert len(kept) == len(rows) and all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in kept)
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(docs(spark), length=100)


def test_repeats_of_random_strings(spark):
    parts = [words(70, 300) for _ in range(6)]
    rows = [(i, " ".join(rng.choice(parts)[rng.randrange(40) :] for _ in range(rng.randrange(1, 5)))) for i in range(60)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs(spark, rows)).collect()}
    assert got == {i: x for (i, _), x in zip(rows, B.repeats([t for _, t in rows], 400), strict=True)}


def near_copies(n):
    """Texts of a few hundred bytes more than `length` that differ in few places, and periodic ones."""
    base = words(260, 900)
    out = []
    for _ in range(n):
        own = base.split()
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(len(own))] = f"z{rng.randrange(9)}"
        out.append(" ".join(own)[rng.randrange(0, 60) : rng.randrange(700, 1400)])
    return out


@pytest.mark.parametrize("length", [400, 256, 301])
@pytest.mark.parametrize("small", [16384, 3])
def test_repeats_of_near_copies(spark, monkeypatch, length, small):
    monkeypatch.setattr(suffix_dedup, "SMALL", small)
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", 50)
    texts = near_copies(40) + ["x" * 400, "x" * 401, "y" * 399 + "z" * 700, "ab" * 400, "b" + "ab" * 150 + "c", "abc" * 133 + "d" * 500 + "abc" * 150, "q" + "abc" * 134, "ab" * 128, "w" * 256, "v" * 257]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs(spark, list(enumerate(texts))), length=length).collect()}
    assert got == dict(enumerate(B.repeats(texts, length)))


def test_repeats_of_long_runs(spark):
    texts = ["a" * 1_000_000, " " * 500_000 + "end", "12 " * 200_000, words(5) + "a" * 399 + words(5), words(9000, 50)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.remove_repeats(docs(spark, list(enumerate(texts)))).collect()}
    assert got[0] == (1_000_000, 1_000_000, 1) and got[1] == (500_003, 500_000, 1) and got[2] == (600_000, 600_000, 1) and got[3][1] == 0
    long = words(2500) + " "
    some = [long + words(300), words(20) + long, words(40)]
    got = {r["doc_id"]: r["kept_sha256"] for r in suffix_dedup.remove_repeats(docs(spark, list(enumerate(some))), length=3000).collect()}
    assert got == {i: x[3] for i, x in enumerate(B.repeats(some, 3000))}
    for i, at, _, within in suffix_dedup._text_anchors([t.encode() for t in texts[:3]], 400):
        assert len(at) < 2000 and len(within) == 1, i


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    text = ("".join(rng.choice("abc d") for _ in range(30000)) + "x" * 3000).encode()
    whole = list(suffix_dedup._text_anchors([text], 400))
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", 1000)
    cut = list(suffix_dedup._text_anchors([text], 400))
    assert (whole[0][1] == cut[0][1]).all() and (whole[0][2] == cut[0][2]).all()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def test_bpe(spark, library):
    rows = [*TEXTS, (31, "".join(chr(c) for c in range(1, 0x3000) if c not in range(0xD800, 0xE000))), (32, " " * 5000 + "a" * 5000), (33, LONG * 4), (7, BASE)]
    for r in bpe.encoded(docs(spark, rows), TOKENIZER, keep=("source",), with_ids=True).collect():
        text = dict(rows)[r["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids"] == ids
        assert r["ids_sha256"] == B.sha(np.array(ids, "<u4").tobytes())
        assert r["decoded_sha256"] == B.sha(library.decode(ids, skip_special_tokens=False).encode())
    assert bpe.encoded(empty(spark), TOKENIZER).count() == 0


def test_chunks_are_reused(library):
    encoder = bpe.ChunkEncoder(bpe.vocabulary(TOKENIZER))
    text = words(6000)
    for t in (text, words(20) + " " + text, text[5000:] + text):
        assert encoder.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids
    assert encoder.reused > encoder.new / 2 > 5
    assert bpe.vocabulary(TOKENIZER).decode(np.array([128, 100], np.uint32)).decode() == library.decode([128, 100], skip_special_tokens=False)


def test_tokens_on_disk(spark, library):
    rows = [*TEXTS, (-5, "before all"), (7, BASE + "!")]
    got = sorted(token_store.store(docs(spark, rows), TOKENIZER, shard_ids=700).collect(), key=lambda r: r["start"])
    at = 0
    mark = {r["text"]: r["m"] for r in docs(spark, rows).select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("m")).collect()}
    for r, (i, t) in zip(got, sorted(rows, key=lambda r: (r[0], mark[r[1]])), strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_store.store(empty(spark), TOKENIZER).count() == 0


def test_grammar():
    r = np.random.default_rng(3)
    for ids in (r.integers(0, 9, 5000), np.tile([1, 2, 3, 1, 2], 800), np.full(3000, 7), r.integers(0, 50000, 400), np.zeros(0, int), np.array([4])):
        blob = token_store.pack(ids.astype(np.uint32), 50257)
        shard = token_store.Shard(blob)
        assert (shard.all() == ids).all() and len(shard.all()) == len(ids)
        for _ in range(30):
            a, b = sorted(r.integers(0, len(ids) + 1, 2).tolist())
            assert (shard.read(a, b) == ids[a:b]).all()
    assert len(token_store.Shard(token_store.pack(np.tile([1, 2, 3, 4], 1000).astype(np.uint32), 50257)).seq) < 200
    for n, size in ((100_000, 60), (100_000, 4000), (400_000, 1000)):
        passage = np.tile(r.integers(0, 50000, size), -(-n // size))[:n].astype(np.uint32)
        for base in (50257, 70_000):
            shard = token_store.Shard(token_store.pack(passage, base))
            assert (shard.all() == passage).all() and len(shard.seq) < n // 100
            assert (shard.read(n // 3, n // 3 + 500) == passage[n // 3 : n // 3 + 500]).all()
    seq, left, right, _ = token_store.repair(r.integers(0, 300, 20_000).astype(np.uint32), 300)
    assert np.unique(seq[:-1].astype(np.uint64) << np.uint64(32) | seq[1:], return_counts=True)[1].max() < 2 * token_store.LEAST
    with pytest.raises(ValueError):
        token_store.Shard(b"nothing")


def test_language_model(spark):
    texts = [words(50, 60) for _ in range(40)] + ["aaab", ""]
    counts = quality._counted(docs(spark, list(enumerate(texts))).select("text"))
    pad = chr(quality.START) * (quality.ORDER - 1)
    model = B.KneserNey([pad + t + chr(quality.STOP) for t in texts], quality.ORDER, 1 << quality.BITS)
    asked = {pad + t + chr(quality.STOP) for t in (*texts[:5], "QQ unseen w1", "w")}
    grams = {line[i : i + quality.ORDER] for line in asked for i in range(len(line) - quality.ORDER + 1)}

    def code(g):
        out = 0
        for c in g:
            out = out << quality.BITS | min(ord(c), (1 << quality.BITS) - 1)
        return out

    needed = spark.createDataFrame([(code(g),) for g in grams], "gram long")
    got = {r["gram"]: r["p"] for r in quality.probabilities(counts, needed).collect()}
    assert len(got) == len(grams)
    for g in grams:
        assert math.isclose(got[code(g)], model.p(g), rel_tol=1e-9)
    assert math.isclose(sum(model.p("w1 w" + chr(c)) for c in range(1 << quality.BITS)), 1.0, rel_tol=1e-6)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality(spark, monkeypatch):
    clean = [(i, words(rng.randrange(60, 200), 200)) for i in range(0, 240)]
    junk = [(i, "!!".join(f"Q{rng.randrange(99)}#" for _ in range(80))) for i in range(240, 270)]
    rows = [*clean, *junk, (900, None), (901, ""), (902, "w1 w2"), (5, clean[5][1])]
    df = docs(spark, rows)
    known = labels(spark, [(i, 1, 0) for i in range(0, 160)] + [(240, 0, 0), (241, 1, 1), (None, 1, 0), (0, 1, 0)])
    got = quality.classify(df, known).collect()
    assert len(got) == len(rows)
    assert all(r["keep"] for r in got if r["doc_id"] < 240 or r["doc_id"] >= 900) and not any(r["keep"] for r in got if 240 <= r["doc_id"] < 270)
    monkeypatch.setattr(quality, "SHARD", 300)
    sharded = quality.classify(df, known).collect()
    key = lambda r: (r["doc_id"], r["n"], round(r["bits_per_char"] or 0, 9), r["keep"])
    assert sorted(map(key, sharded)) == sorted(map(key, got))
    assert all(r["keep"] for r in quality.classify(df, labels(spark, [])).collect())
    assert quality.classify(empty(spark), known).count() == 0
    kept = quality.keep_good(df, known)
    assert kept.columns == df.columns and kept.count() == len(rows) - 30


def test_nearest(spark):
    r = np.random.default_rng(8)
    centers = r.standard_normal((40, 32))
    base = [(i, (centers[i % 40] + 0.6 * r.standard_normal(32)).astype(np.float32).tolist()) for i in range(6000)]
    base[60] = (60, base[0][1])
    base[61] = (61, base[0][1])
    odd = [(6000, None), (6020, []), (6040, [0.0] * 32), (6060, [float("nan")] + [1.0] * 31), (6080, [None] + [1.0] * 31), (6100, [1.0] * 3), (6101, [2.0] * 3), (None, base[3][1])]
    df = spark.createDataFrame([(i, v, 1, "clash") for i, v in base + odd], "vec_id long, embedding array<float>, rank int, vector string").repartition(3)
    got = {}
    for row in ann.search(df).collect():
        got.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    x, names = np.array([v for _, v in base], np.float32).astype(float), np.arange(6000)
    hit = 0
    exact = ann.all_pairs(x, names, np.arange(0, 6000, 20), 20)
    assert set(got) == {q for q, _ in exact} | {6100}
    assert got[6100] == [(1, 6101, 6.0)]
    for q, best in exact:
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 21)) and q not in {v for _, v, _ in own}
        assert all(math.isclose(s, float((x[v] * x[q]).sum()), rel_tol=1e-12) for _, v, s in own)
        assert [v for _, v, _ in own] == [v for _, v, _ in sorted(own, key=lambda o: (-o[2], o[1]))]
        hit += len({v for _, v, _ in own} & set(best))
    assert hit / (20 * len(exact)) >= 0.9
    first = [v for _, v, _ in sorted(got[60])]
    assert 0 not in first or first[first.index(0) + 1] == 61
    few = ann.search(df.where("vec_id < 5")).collect()
    assert [(r["query_id"], r["rank"]) for r in few] == [(0, i) for i in range(1, 5)]
    assert ann.search(df.limit(0)).count() == 0


def test_scanner_abandons():
    r = np.random.default_rng(2)
    x = r.standard_normal((2000, 64))
    rotation = np.linalg.qr(r.standard_normal((64, 64)))[0]
    scanner = ann.Scanner(np.arange(2000), np.arange(2000), x, rotation)
    q = x[0]
    scores = ann.exact(x, q)
    bound = np.sort(scores)[-30]
    names, got = scanner.search(q, q @ rotation, 0, bound, 20)
    best = [i for i in np.argsort(-scores) if i][:20]
    assert len(set(names.tolist()) & set(best)) >= 19 and (got >= bound).all()


def test_personal_data(spark):
    rows = [*TEXTS, (40, "9" * 4000 + "." + "1." * 500), (41, "a" * 5000 + "@" + "b" * 5000), (42, "+1" + " " * 3000 + "2" * 9), (43, "1.2.3.4@x.y 00000000255.1.1.1"), (24, TEXTS[-1][1])]
    for r in pii.find(docs(spark, rows), steps=40).collect():
        counts, listed = B.spans(dict(rows)[r["doc_id"]], B.PERSONAL)
        assert r["base_sha256"] == B.sha(listed.encode()), r["doc_id"]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [counts.get(k, 0) for k in pii.KINDS]
        assert set(filter(None, listed.split(","))) <= set(r["spans"].split(","))
    assert pii.find(empty(spark), steps=40).count() == 0


def test_tagger_learns():
    model = pii.trained()
    x, y = pii.labelled(np.random.default_rng(77), 300)
    tags = model.decode(x)
    assert (tags == y).mean() > 0.97 and (tags == y)[y > 0].mean() > 0.93
    text = "please call (415) 555-0134 or 212-555-0187 today, version 1.2.3 of 2024"
    found = pii.model_spans([text, "nothing here", ""], model)
    assert any(text[a:b].startswith("(415)") for a, b, _ in found[0]) and found[1:] == [[], []]
    small, noise = pii.Tagger(1), np.random.default_rng(4)
    x, y = pii.labelled(noise, 2)
    _, grad = small.step(x, y)
    for name in small.p:
        at = tuple(noise.integers(0, n) for n in small.p[name].shape)
        small.p[name][at] += 1e-5
        up, _ = small.step(x, y)
        small.p[name][at] -= 2e-5
        down, _ = small.step(x, y)
        small.p[name][at] += 1e-5
        assert math.isclose(grad[name][at], (up - down) / 2e-5, rel_tol=1e-3, abs_tol=1e-6)


def test_secrets(spark):
    rows = [*TEXTS, (50, 'token="' + "z" * 40000), (51, "password:abc " * 3000), (52, "f" * 31 + " " + "0" * 33), (23, TEXTS[-2][1])]
    example = 'api_key = "EXAMPLE1234abcd"'
    rows += [(60 + i, f"{words(5)} {example}") for i in range(10)]
    got = secret_scan.report(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        counts, listed = B.spans(dict(rows)[r["doc_id"]], B.SECRETS)
        assert r["base_sha256"] == B.sha(listed.encode()), r["doc_id"]
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [counts.get(k, 0) for k in ("assign", "access", "hex")]
        base = [s for s in r["spans"].split(",") if s and not s.startswith("live:")]
        assert ",".join(base) == listed
        assert r["n_live"] == r["spans"].count("live:")
    seen = {r["doc_id"]: r for r in got}
    assert seen[23]["n_live"] >= 2 and seen[60]["n_live"] == 0 and seen[60]["n_example"] == 1
    assert secret_scan.report(empty(spark)).count() == 0
    hidden = by_id(secret_scan.redact(docs(spark, rows)).dropDuplicates(["doc_id"]))
    assert "k3yV4lue" not in hidden[23]["text"] and "[SECRET]" in hidden[23]["text"] and hidden[23]["n_chars"] == len(hidden[23]["text"])
    assert example in hidden[60]["text"] and hidden[1]["text"] is None and hidden[6]["text"] == BASE


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
@pytest.mark.parametrize("hot", [64, 2])
def test_jaccard(spark, monkeypatch, size, percent, hot):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 7)
    family = []
    for i in range(30):
        own = BASE.split()
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(len(own))] = f"new{rng.randrange(99)}"
        family.append((100 + i, " ".join(own)))
    rows = [*TEXTS, *family]
    expected = B.jaccard(rows, size, percent)
    df = docs(spark, [*rows, (6, BASE)])
    got = jaccard.classes(df, size=size, percent=percent).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]], r["doc_id"]
    kept = jaccard.keep_one(df, size=size, percent=percent)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in expected.items() if i == c)
    assert jaccard.classes(empty(spark)).count() == 0
    # An id that two unlinked texts share keeps both, and so does a text without an id.
    shared = docs(spark, [(5, words(30)), (5, words(30)), (6, BASE), (6, BASE.upper()), (7, BASE), (None, BASE), (8, ""), (8, " ")])
    assert sorted(str(r["doc_id"]) for r in jaccard.keep_one(shared, size=size, percent=percent).collect()) == ["5", "5", "6", "8", "8", "None"]


def test_overlaps(monkeypatch):
    r = np.random.default_rng(12)
    a = [np.unique(r.integers(0, 60, r.integers(1, 50)).astype(np.uint64)) for _ in range(33)]
    b = [np.unique(r.integers(0, 90, r.integers(1, 50)).astype(np.uint64)) for _ in range(21)]
    for dense in (0, 100, 10**9):
        monkeypatch.setattr(jaccard, "DENSE", dense)
        monkeypatch.setattr(jaccard, "PAIRS_AT_ONCE", 50)
        assert (jaccard.overlaps(a, b) == [[len(np.intersect1d(x, y)) for y in b] for x in a]).all()
        assert (jaccard.overlaps(a, a) == [[len(np.intersect1d(x, y)) for y in a] for x in a]).all()


@pytest.mark.parametrize("block", [2048, 40])
def test_embeddings(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    monkeypatch.setattr(embed_dedup, "AT_ONCE", 64)
    r = np.random.default_rng(6)
    rows = []
    for i in range(240):
        v = r.standard_normal(16) if i % 4 == 0 or not rows else np.array(rows[int(r.integers(0, len(rows)))][1]) + 0.09 * r.standard_normal(16)
        rows.append((i, v.astype(np.float32).tolist(), int(r.integers(0, 3))))
    rows += [(300 + i, rows[0][1], rows[0][2]) for i in range(9)] + [(320, [2 * x for x in rows[0][1]], rows[0][2])]
    rows += [(400, None, 0), (401, [0.0] * 16, 0), (402, [float("inf")] + [1.0] * 15, 0), (403, [None] * 16, 0), (404, rows[0][1], None), (405, [], 0), (406, [1.0] * 3, 0)]
    expected = B.near_vectors(rows, 0.93)
    df = spark.createDataFrame([(*x, "clash", 1) for x in rows], "vec_id long, embedding array<float>, label int, unit string, n_links int").repartition(3)
    got = embed_dedup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    for row in got:
        assert (row["n_links"], row["component_id"]) == expected[row["vec_id"]], row["vec_id"]
        assert row["kept"] == (row["vec_id"] == row["component_id"])
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_cover_tree():
    r = np.random.default_rng(1)
    x = r.standard_normal((700, 8))
    x[100:200] = x[0] + 0.02 * r.standard_normal((100, 8))
    x /= np.linalg.norm(x, axis=1)[:, None]

    def walk(node, scale):
        assert (np.linalg.norm(x[node.points] - x[node.center], axis=1) <= node.radius + 1e-9).all()
        if node.children:
            assert sorted(np.concatenate([c.points for c in node.children]).tolist()) == sorted(node.points.tolist())
            assert any(c.center == node.center for c in node.children)
        for c in node.children:
            walk(c, scale / 2)

    walk(embed_dedup.cover_tree(x), 2.0)
    found = sorted((min(p), max(p)) for i, j in embed_dedup.close_pairs(x, None, 0.9) for p in zip(i.tolist(), j.tolist(), strict=True))
    assert found == sorted((i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.9, 1)), strict=True))


def test_no_text_is_matched_by_a_prefix_only(spark):
    tail = LONG * 3 + ' password = "aB3dE5gH7jK9"'
    row = secret_scan.report(docs(spark, [(1, tail)])).first()
    assert re.search(r"live:\d{5}", row["spans"]) and row["n_assign"] == 1
    assert F is not None
