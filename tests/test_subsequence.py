"""The ratios in the JVM against the Python functions of their definitions."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.functions import similarity, subsequence


def _pairs(seed, n, longest, signs="aabbc d é🙂ก"):
    r = random.Random(seed)

    def text():
        return "".join(r.choice(signs) for _ in range(r.randrange(0, longest)))

    out = [(text(), text()) for _ in range(n)]
    for _ in range(n // 2):  # related ones
        a = text()
        k = r.randrange(0, len(a) + 1)
        out += [(a, a[k:]), (a, a[:k] + text()[:3] + a[k:]), (a[:k][::-1], a), (a, " ".join(reversed(a.split())))]
    return [*out, ("", ""), ("", "a"), ("a", ""), (" ", "a b"), ("b a", "a b"), ("a b", "a b c")]


@pytest.mark.parametrize(("n", "longest"), [(150, 14), (25, 90), (4, 200)])
def test_ratios(spark, n, longest):
    pairs = _pairs(longest, n, longest)
    df = spark.createDataFrame(pairs, "a string, b string").repartition(4)
    got = df.select("a", "b", *[getattr(subsequence, f)(F.col("a"), F.col("b")).alias(f) for f in ("ratio", "partial_ratio", "token_set_ratio")]).collect()
    assert len(got) == len(pairs)
    for x in got:
        assert x.ratio == pytest.approx(similarity.py_ratio(x.a, x.b)), (x.a, x.b)
        assert x.partial_ratio == pytest.approx(similarity.py_partial_ratio(x.a, x.b)), (x.a, x.b)
        assert x.token_set_ratio == pytest.approx(similarity.py_token_set_ratio(x.a, x.b)), (x.a, x.b)


def test_no_python_workers(spark):
    df = spark.createDataFrame([("a", "b")], "a string, b string")
    plan = df.select(subsequence.partial_ratio(F.col("a"), F.col("b")), subsequence.token_set_ratio(F.col("a"), F.col("b")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
