"""Bounds of the ratios, and the search that leaves out what cannot come up to them."""

import random

from pyspark.sql import functions as F

from recordloom.functions import similarity
from recordloom.functions import subsequence as S
from recordloom.operators import search as fuzzy


def test_bounds_are_never_under_the_ratios(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abกé😀 ") for _ in range(r.randrange(0, 9))).strip()
    rows = [(word(), word()) for _ in range(300)] + [(f"{word()} {word()} x", f"x {word()} {word()}") for _ in range(200)] + [("ab ab", "ab"), ("", "a"), ("aab", "aab")]
    df = spark.createDataFrame(rows, "a string, b string").withColumn("of", S.counted(F.col("a")))
    pairs = [(S.most_ratio, S.ratio), (S.most_partial_ratio, S.partial_ratio), (S.most_token_set_ratio, S.token_set_ratio)]
    under = [F.sum((most(F.col("of"), F.col("a"), F.col("b")) + 1e-6 < exact(F.col("a"), F.col("b"))).cast("int")).alias(f"n{i}") for i, (most, exact) in enumerate(pairs)]
    assert tuple(df.agg(*under).first()) == (0, 0, 0)


def test_search_is_that_of_all_scored_rows(spark, monkeypatch):
    """Rows against a plain ranking of all candidates, with few and with many rows scored for the first limit; shared grams at the threshold count."""
    r = random.Random(8)
    rows = [(i, f"{r.choice(['ann', 'bob', 'anna'])} item#{r.randrange(300):06}", f"08{r.randrange(9999):08}", f"1กก{r.randrange(300)}", r.choice(["ford", "honda", None]), "approved", r.random() < 0.5, r.randrange(3)) for i in range(250)]
    df = spark.createDataFrame(rows, "id int, name_norm string, tel_digits string, plate_norm string, brand_norm string, review_status string, stored boolean, created int")
    texts = ["item#000042", "bob item#000011", "0800000042", "1กก77", "hond", "abc"]
    grams = lambda t: {p[i : i + 3] for w in "".join(c if c.isalnum() else " " for c in t or "").split() for p in [f"  {w} "] for i in range(len(p) - 2)}

    def near(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return a != "" and b != "" and d[-1] <= 2

    want = set()
    for q in fuzzy.asked(spark, texts).collect():
        found = []
        for i, name, tel, plate, brand, _, stored, created in rows:
            sets = [(grams(a), grams(b)) for a, b in ((q.q_name, name), (q.q_plate, plate), (q.q_brand, brand))]
            held = q.q_tel != "" and q.q_tel in tel
            if any(x & y and len(x & y) / len(x | y) >= 0.3 for x, y in sets) or held or near(q.q_tel, tel) or near(q.q_plate, plate):
                pair = lambda f, a, b: f(a, b) if a and b else 0.0
                s = {"tel": 100.0 if held else pair(similarity.py_ratio, q.q_tel, tel), "plate": pair(similarity.py_ratio, q.q_plate, plate)}
                s["name"], s["brand"] = max(pair(similarity.py_token_set_ratio, q.q_name, name), pair(similarity.py_partial_ratio, q.q_name, name)), pair(similarity.py_partial_ratio, q.q_brand, brand)
                found.append((-round(max(s[f] * similarity.WEIGHTS[q.kind][f] for f in s), 1), not stored, -created, i))
        want |= {(q.q, n, x[3], -x[0]) for n, x in enumerate(sorted(found)[:7], 1)}
    assert len(want) > 25
    for first in (1, fuzzy.FIRST):
        monkeypatch.setattr(fuzzy, "FIRST", first)
        assert {(x.q, x["rank"], x.id, x.score) for x in fuzzy.search(df, texts, top=7).collect()} == want
