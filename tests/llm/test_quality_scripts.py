"""Each character of each script has symbols of its own in the quality classifier."""

import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from spectrafold.llm import quality  # noqa: E402


def test_symbols_lose_nothing():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(map(chr, points))
    own = quality.symbols(text)
    assert own.min() >= 0 and own.max() < 1 << quality.BITS
    lead = np.flatnonzero(own >= quality.LEADS)
    assert (own[lead + 1] < quality.LEADS).all()
    whole = own.copy()
    whole[lead] = quality.LEADS + (own[lead] - quality.LEADS) * quality.LEADS + own[lead + 1]
    assert np.delete(whole, lead + 1).tolist() == points
    assert quality.grams("plain é").tolist() == quality.grams("plain é ").tolist()[:7] + quality.grams("plain é")[-1:].tolist()


def test_junk_of_other_scripts_is_rejected(spark, monkeypatch):
    rng = random.Random(3)
    words = ["".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(rng.randrange(1, 4))) for _ in range(120)]
    prose = lambda n: "".join(rng.choice(words) for _ in range(n))
    clean = [(i, prose(rng.randrange(40, 400)), "zh") for i in range(200)]
    clean[7] = (7, clean[7][1] + "🙂", "zh")
    kinds = [(0x4E00, 20000), (0xAC00, 11000), (0x10A0, 90), (0x1F600, 60), (0x1780, 90), (0x1200, 300)]
    junk = [(500 + i, "".join(chr(kinds[i % 6][0] + rng.randrange(kinds[i % 6][1])) for _ in range(300)), "zh") for i in range(30)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(df, labels).collect()}
    assert sum(not got[i]["keep"] for i in range(200)) <= 1
    assert not any(got[i]["keep"] for i, _, _ in junk)
    assert all(got[i]["n"] == len(t) for i, t, _ in clean + junk)
    monkeypatch.setattr(quality, "SHARD", 4000)
    for r in quality.classify(df, labels).collect():
        assert abs(r["bits_per_char"] - got[r["doc_id"]]["bits_per_char"]) < 1e-9 and r["keep"] == got[r["doc_id"]]["keep"]
