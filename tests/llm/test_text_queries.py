import pytest

from plumbline.llm import queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


@pytest.mark.parametrize("name", ["p1_found", "p2_found", "p3_found", "p5_found", "p9_found"])
def test_no_row_twice(spark, sf, name):
    df = queries.queries()[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
