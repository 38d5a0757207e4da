"""Copies of a document don't turn its secret into an example."""

import random

import duckdb
import pytest

pytest.importorskip("public_tokenizers")
from spectrafold.llm import oracles, secret_scan  # noqa: E402

rng = random.Random(9)


def prose(n: int) -> str:
    return " ".join(f"w{rng.randrange(4000):x}" for _ in range(n))


def key() -> str:
    return "".join(rng.choice("0123456789abcdef") for _ in range(40))


def test_copies_count_once(spark):
    copied, near, moved, used, alone, pair = (key() for _ in range(6))
    whole = f'{prose(30)} token = "{copied}" {prose(30)}'
    rows = [(i, whole, f"s{i % 7}") for i in range(40)]
    head, tail = prose(40), prose(40)
    rows += [(100 + i, f'{prose(3)} {head} secret: {near} {tail} {prose(3)}', f"s{i}") for i in range(6)]
    # One owner uses a key in three documents, two of which were copied by others.
    own = [f'{prose(20)} password="{moved}" {prose(20)}' for _ in range(3)]
    rows += [(200 + i, t, s) for i, (t, s) in enumerate([(own[0], "a"), (own[1], "a"), (own[2], "a"), (own[0], "b"), (own[1], "c"), (own[1], None)])]
    rows += [(300 + i, f'{prose(20)} api_key={used} {prose(20)}', f"s{i}") for i in range(3)]
    # Of an example, one text was copied as well.
    rows += [(400 + i, rows[-1][1], f"t{i}") for i in range(4)]
    rows += [(500 + i, f"token={alone}", f"s{i}") for i in range(5)]
    texts = [f"{prose(20)} token={pair} {prose(20)}" for _ in range(4)]
    rows += [(600 + i, texts[i % 4], ["a", "b"][i % 2]) for i in range(8)]
    df = spark.createDataFrame([(i, t, s, len(t)) for i, t, s in rows], "doc_id long, text string, source string, n_chars long").repartition(3)
    got = {r["doc_id"]: r for r in secret_scan.report(df).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        example = used in t
        assert (got[i]["n_live"] > 0) != example and (got[i]["n_example"] > 0) == example, i
        assert ("live:" in got[i]["spans"]) != example
    # The SQL gives the same rows.
    duck = duckdb.connect()
    duck.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    duck.executemany("insert into documents values (?, ?, ?)", [list(r) for r in rows])
    sql = duck.execute(oracles.secrets())
    columns = [d[0] for d in sql.description]
    assert sorted(sql.fetchall()) == sorted(tuple(r[c] for c in columns) for r in got.values())
    hidden = {r["doc_id"]: r["text"] for r in secret_scan.redact(df).collect()}
    for i, t, _ in rows:
        assert ("[SECRET]" in hidden[i]) != (used in t)
        assert not any(k in hidden[i] for k in (copied, near, moved, alone, pair))
