"""What the quality classifier's limit rejects and keeps."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
from spectrafold.llm import quality  # noqa: E402

from . import brute as B  # noqa: E402

DATA = "/root/testdata/sf0.1"


def kind(label, text: str) -> str:
    if label["quality"]:
        return "toxic" if label["toxic"] else "clean"
    w = text.split()
    if sum(a == b for a, b in zip(w, w[1:], strict=False)) > 0.3 * (len(w) - 1):
        return "repeated words"
    return "fragments" if text.count("|") > 5 else "capitals" if text.count("!") > 10 else "symbols"


def quantile(values, share, step=0.002):
    bins = sorted(math.floor(v / step) for v in values)
    return (bins[next(i for i in range(len(bins)) if (i + 1) / len(bins) >= share)] + 0.5) * step


def plainly(rows, trusted, held, drift=0.02):
    """(bits a character, limit, keep) of each (doc_id, text, lang), by dictionaries."""
    pad = chr(quality.START) * (quality.ORDER - 1)
    line = lambda t: pad + t + chr(quality.STOP)
    model = B.KneserNey([line(t) for i, t, _ in rows if i in trusted and i not in held], quality.ORDER, 1 << quality.BITS)
    known = {}

    def bits(t):
        own = [line(t)[i : i + quality.ORDER] for i in range(len(t) + 1)]
        for g in own:
            if g not in known:
                known[g] = -math.log2(model.p(g))
        return sum(known[g] for g in own) / (len(t) + 1)

    score = [bits(t) if t else None for _, t, _ in rows]
    unit = [math.sqrt(1 / max(1, len(t)) + drift**2) for _, t, _ in rows]

    def limits(judges):
        middle = quantile([score[i] for i in judges], 0.5)
        z = [(score[i] - middle) / unit[i] for i in judges]
        return middle, max(quantile(z, 0.998), 2 * max(quantile(z, 0.95), quality.LEAST_SPREAD)) * math.sqrt(1 + quality.FEW / len(z))

    judges = [i for i, (name, t, _) in enumerate(rows) if name in held and t]
    own = {lang: limits([i for i in judges if rows[i][2] == lang]) for lang in {rows[i][2] for i in judges}}
    every = limits(judges)
    out = []
    for i, (_, t, lang) in enumerate(rows):
        middle, beyond = own.get(lang, every)
        limit = middle + beyond * unit[i] + quality.BITS / (len(t) + 1)
        out.append((score[i], limit, not t or score[i] <= limit))
    return out


def test_scores_limits_and_verdicts(spark):
    """All that the classifier says, against a plain version; ids repeat and are null."""
    r = random.Random(2)
    text = lambda w, n: " ".join(r.choice(w) for _ in range(n))
    some = {"en": ["the", "cat", "sat", "on", "a", "mat", "\x02", "then", "slept"], "pl": ["żółw", "idzie", "przez", "las"], None: ["no", "language", "here"]}
    rows = [(i, text(some[lang], r.randrange(3, 60)), lang) for i, lang in enumerate(r.choices(["en", "pl", None], k=260))]
    rows += [(300 + i, "".join(r.choice("#$%QXZ0123") for _ in range(90)), "en") for i in range(6)]
    rows += [(400, text(some["en"], 9), "xx"), (401, "QQQQ ZZZZ 9999 " * 9, "xx"), (402, "", "en"), (230, "#Q$X%Z" * 20, "en"), (None, "%Z$Q#X" * 20, "en"), (None, rows[3][1], rows[3][2])]
    docs = spark.createDataFrame([(*x, "clash", 1) for x in rows], "doc_id long, text string, lang string, key string, n int").repartition(3)
    trusted = set(range(200))
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted] + [(201, 0, 0), (202, 1, 1)], "doc_id long, quality int, toxic int")
    held = {x["doc_id"] for x in labels.where("quality = 1 and toxic = 0").select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(quality.HELD_OUT)) == 0).alias("h")).collect() if x["h"]}
    rounded = lambda x: None if x is None else round(x, 4)
    expected = Counter((i, lang, len(t), rounded(score), rounded(limit), keep) for (i, t, lang), (score, limit, keep) in zip(rows, plainly(rows, trusted, held), strict=True))
    got = Counter((x["doc_id"], x["lang"], x["n"], rounded(x["bits_per_char"]), rounded(x["limit"]), x["keep"]) for x in quality.classify(docs, labels).collect())
    assert got == expected, [sorted(x for x in c if x[0] in (2, 3)) for c in (got, expected)]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = Counter((x["doc_id"], x["text"]) for x in kept.collect())
    assert ids[230, rows[230][1]] == 1 and ids[230, "#Q$X%Z" * 20] == 0 and ids[None, "%Z$Q#X" * 20] == 0 and ids[None, rows[3][1]] == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_shares_of_labelled_rows(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    known = {r["doc_id"]: r for r in labels.collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect() if r["doc_id"] in known}
    rows, gone = Counter(), Counter()
    for r in quality.classify(docs, labels).collect():
        if texts.get(r["doc_id"]):
            k = kind(known[r["doc_id"]], texts[r["doc_id"]])
            rows[k] += 1
            gone[k] += not r["keep"]
    print({k: (gone[k], rows[k]) for k in sorted(rows)})
    share = {k: gone[k] / rows[k] for k in rows}
    assert share["clean"] <= 0.002
    assert share["repeated words"] >= 0.8
    assert min(share["fragments"], share["capitals"], share["symbols"]) >= 0.98


def test_long_documents_have_a_closer_limit(spark):
    r = np.random.default_rng(4)
    vocabulary = ["".join(r.choice(list("etaoinshrdlucmfw"), r.integers(2, 8))) for _ in range(300)]
    share = 1 / np.arange(1, 301)
    text = lambda n: " ".join(r.choice(vocabulary, n, p=share / share.sum()))
    clean = [(i, text(r.integers(20, 900)), "en") for i in range(300)]
    # Every fourth word is rare: a little over the usual bits a character, all through a long text.
    odd = [(1000 + i, " ".join(w if j % 4 else vocabulary[-1 - j % 150] for j, w in enumerate(text(2000).split())), "en") for i in range(20)]
    docs = spark.createDataFrame(clean + odd, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality.classify(docs, labels).collect()}
    assert sum(not got[i]["keep"] for i in range(300)) <= 1
    assert not any(got[1000 + i]["keep"] for i in range(20))
