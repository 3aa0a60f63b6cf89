"""Folds of the first row of a key, and field changes, against plain loops."""

import random

from recordloom.operators import mutate


def test_first_of(spark):
    r = random.Random(2)
    rows = [(i, r.choice([None, "a", "b", "hot", "hot", "hot"]), r.choice([None, 1, 2, 3])) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, k string, at int").repartition(4)
    got = sorted(tuple(x) for x in mutate.first_of(df, ["k"], ["at", "id"]).collect() if x.k) + [tuple(x) for x in mutate.first_of(df, ["k"], ["at", "id"]).collect() if not x.k]
    first = {}
    for i, k, at in sorted(rows, key=lambda x: (x[2] is not None, x[2] or 0, x[0])):
        first.setdefault(k, (i, k, at))
    assert sorted(got, key=str) == sorted(first.values(), key=str)
    assert mutate.first_of(df.limit(0), ["k"], ["at"]).count() == 0


def test_audit_diff(spark):
    old = [(1, "a", 1, None), (2, "b", 2, "x"), (3, None, 3, ""), (4, "gone", 1, "")]
    new = [(1, "a", 2, ""), (2, None, 2, "y"), (3, "", 3, None), (5, "new", 1, "")]
    schema = "id int, s string, n int, t string"
    got = mutate.audit_diff(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), "id", ["s", "n", "t"]).collect()
    assert sorted((x.id, x.field, x.old_value, x.new_value) for x in got) == [(1, "n", "1", "2"), (2, "s", "b", None), (2, "t", "x", "y")]
