"""The operators' queries against their SQL."""

import math
import os

import duckdb
import pytest

pytest.importorskip("public_tokenizers")
from spectrafold.llm import queries as Q  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings"):
        duck.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    df = Q.queries()[name](spark, DATA)
    found = duck.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    ours = sorted(tuple(r[c] for c in sorted(columns)) for r in df.collect())
    theirs = sorted(tuple(r[columns.index(c)] for c in sorted(columns)) for r in found.fetchall())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert all(x == y or (isinstance(x, float) and math.isclose(x, y, rel_tol=1e-12)) for x, y in zip(a, b, strict=True))
