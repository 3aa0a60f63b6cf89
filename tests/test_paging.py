"""Deep pages against a sort of all rows."""

import random

import pytest

from recordloom.operators import paging

ORDER = [("a", True), ("b", False), ("id", False)]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(3)
    data = [(i, r.choice([None, *range(6)]), r.choice([None, "x", "y", "zz"]), "keep") for i in range(3_000)]
    df = spark.createDataFrame(data, "id int, a int, b string, other string").repartition(6).cache()
    key = lambda x: (x[1] is None, -(x[1] or 0), x[2] is None, x[2] or "", x[0])
    return df, sorted(data, key=key)


@pytest.mark.parametrize("number", [-1, 1, 2, 17, 60, 61])
def test_pages(rows, number):
    df, want = rows
    at = max(0, number - 1) * 50
    assert [tuple(x) for x in paging.page_at(df, ORDER, number, 50, most=200).collect()] == want[at : at + 50]


def test_only_a_span_is_sorted(rows):
    df, want = rows
    for offset in (0, 1_234, 2_990):
        span = paging.locate(df, ORDER, offset, 50, most=200)
        assert span.rank <= offset and span.rows <= 200 and span.rank + span.rows >= min(3_000, offset + 50)
        inside = [tuple(x) for x in paging.within(df, ORDER, span).collect()]
        assert sorted(inside) == sorted(want[span.rank : span.rank + span.rows])
        page = paging.page_at(df, ORDER, offset // 50 + 1, 50, most=200)
        assert "Exchange rangepartitioning" not in page._jdf.queryExecution().executedPlan().toString()


def test_equal_rows_and_empty_lists(spark, rows):
    same = spark.createDataFrame([(1, 1, "x", "")] * 500 + [(2, None, None, "")] * 3, "id int, a int, b string, other string")
    assert [x.id for x in paging.page_at(same, ORDER, 11, 50, most=20).collect()] == [2] * 3
    assert paging.page_at(same, ORDER, 5, 50, most=20).count() == 50
    assert paging.page_at(rows[0].limit(0), ORDER, 1).count() == 0
