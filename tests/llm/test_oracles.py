"""The queries of this subpackage that SQL can express, against it on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from plumbline.llm import queries as Q


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, sf, duck, name):
    df = Q.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = Counter(tuple(r[c] for c in cols) for r in df.collect())
    rel = duck.execute(Q.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    assert got == Counter(tuple(dict(zip(names, row, strict=True))[c] for c in cols) for row in rel.fetchall())
