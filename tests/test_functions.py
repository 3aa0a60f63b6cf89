"""Normalisers and rules against plain Python definitions and table-driven cases."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.functions import dates, rules, similarity, text


def _one(spark, value, *columns):
    row = spark.createDataFrame([(value,)], "v string").select(*[f(F.col("v")).alias(f"c{i}") for i, f in enumerate(columns)]).first()
    return tuple(row)


def _many(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in rows.select("i", f(F.col("v"))).orderBy("i").collect()]


def test_dates(spark):
    cases = {
        "26/9/69": "2026-09-26", "26/09/2569": "2026-09-26", "26/09/2026": "2026-09-26", "26 ก.ย. 69": "2026-09-26", "26 กันยายน 2569": "2026-09-26", "๒๖/๙/๖๙": "2026-09-26",
        "2026-09-26": "2026-09-26", "26 ก.ย.": "2026-09-26", "26": "", "": "", None: "", "32/13/69": "", "26/9/26": "2026-09-26", "29/2/68": "", "29/2/67": "2024-02-29", "1 นี้ 69": "",
    }
    assert _many(spark, list(cases), lambda c: dates.iso(c, 2026)) == list(cases.values())


def test_phones_plates_names(spark):
    assert _many(spark, ["080-000-0000", "080 000 0000", "๐๘๐๐๐๐๐๐๐๐", "+66800000000", None, "x"], text.phone) == ["0800000000"] * 4 + ["", ""]
    plates = ["1กก 1234 กรุงเทพ", "ขข 9999 อยุธยา", "กก-1234", " 1กก.12 "]
    assert _many(spark, plates, text.plate) == ["1กก1234", "ขข9999", "กก1234", "1กก12"]
    assert _many(spark, plates, lambda c: text.plate_parts(c)["province"]) == ["กรุงเทพ", "อยุธยา", None, None]
    assert _many(spark, ["นาย สมชาย  ใจดี", "น.ส.สมหญิง รักไทย", "Mr. A", "นายนาย ก", ""], text.name) == ["สมชาย ใจดี", "สมหญิง รักไทย", "a", "นาย ก", ""]
    assert _many(spark, ["โตโยต้ายาริสสีขาว", "TOYOTA VIOS", "IZUZU", "อีซูซุ", "Honda City", "BMW"], text.brand) == ["toyota", "toyota", "isuzu", "isuzu", "honda", "bmw"]
    assert _many(spark, ["กทม.", "BKK", "พระนครศรีอยุธยา", "Trang"], text.province) == ["กรุงเทพ", "กรุงเทพ", "อยุธยา", "trang"]
    assert _many(spark, ["​ A ﻿", "__new__", None], text.person) == ["A", "", ""]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aB1๒ กิ์-.\t นาย", max_size=12), min_size=1, max_size=20))
def test_base_is_idempotent(spark, values):
    once = _many(spark, values, text.base)
    assert _many(spark, once, text.base) == once
    import re
    import unicodedata

    digits = str.maketrans("๐๑๒๓๔๕๖๗๘๙", "0123456789")
    assert once == [re.sub(r"\s+", " ", unicodedata.normalize("NFC", v).translate(digits)).strip() for v in values]


@pytest.mark.parametrize(
    ("fields", "conf", "dup", "want"),
    [
        ({"name": "ก ข", "tel": "0812345678", "noplate": "1กก1234", "date": "26/9/69"}, {"name": 0.9}, 0, []),
        ({"name": "ก ข", "tel": "0812", "noplate": "1กก1234"}, {}, 0, ["format_invalid"]),
        ({"name": " ", "tel": "0812345678", "noplate": "1กก1234"}, {}, 0, ["missing_field"]),
        ({"name": "ก", "tel": "0812345678", "noplate": "1234"}, {"tel": 0.4}, 1, ["duplicate_suspect", "format_invalid", "low_confidence"]),
        ({"name": "ก", "tel": "-", "noplate": "1กก1"}, {"tel": 0.85}, 0, []),
    ],
)
def test_review(spark, fields, conf, dup, want):
    cols = {k: F.lit(v) for k, v in fields.items()}
    m = F.create_map(*[x for k, v in {**conf, "z": 1.0}.items() for x in (F.lit(k), F.lit(v))])
    low = rules.low_fields(m)
    row = spark.range(1).select(rules.evaluate(rules.field_problems(cols, 2026), low, F.lit(dup)).alias("r")).first()
    assert row.r == want


def test_ratios():
    assert similarity.py_ratio("", "") == 100 and similarity.py_ratio("abc", "abd") == pytest.approx(200 * 2 / 6)
    assert similarity.py_partial_ratio("ab", "xxabxx") == 100
    assert similarity.py_token_set_ratio("a b", "b a c") == 100
    assert similarity.py_token_set_ratio("สมชาย ใจดี", "ใจดี สมชาย") == 100


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=12))
def test_lcs_against_the_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    assert similarity._lcs(a, b) == t[-1][-1]


def test_hof_ratio_equals_python(spark):
    pairs = [("kitten", "sitting"), ("", "a"), ("", ""), ("กขค", "กค"), ("abc", "abc")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(r.r == pytest.approx(similarity.py_ratio(r.a, r.b)) for r in rows)


def test_edit_pairs_find_all(spark):
    words = ["abc", "abd", "xbd", "abcd", "b", "", "zzzz", "bca"]
    df = spark.createDataFrame([(w, w) for w in words], "id string, value string")
    got = {(r.l, r.r): r.distance for r in similarity.edit_pairs(df, df).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row = _next(row, i, x, b)
        return row[-1]

    def _next(row, i, x, b):
        out = [i + 1]
        for j, y in enumerate(b):
            out.append(min(row[j] + (x != y), row[j + 1] + 1, out[j] + 1))
        return out

    assert got == {(a, b): lev(a, b) for a in words for b in words if lev(a, b) <= 2}


def test_edit_pairs_and_trigram_pairs_against_all_pairs(spark):
    import random

    r = random.Random(7)
    words = {"".join(r.choice("abcกé") for _ in range(r.randrange(0, 14))) for _ in range(60)} | {"", "a", "the same long word " * 3}
    for w in list(words)[:40]:  # edited ones
        x = list(w)
        for _ in range(r.randrange(1, 4)):
            at = r.randrange(len(x) + 1)
            x[at : at + r.randrange(2)] = r.choice(["", "b", "z"])
        words.add("".join(x))
    words = sorted(words)
    df = spark.createDataFrame([(w, w) for w in words] + [(None, None)], "id string, value string")
    got = {(x.l, x.r): x.distance for x in similarity.edit_pairs(df, df).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            old, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(old[j] + (x != y), old[j + 1] + 1, row[j] + 1))
        return row[-1]

    assert got == {(a, b): lev(a, b) for a in words for b in words if lev(a, b) <= 2}
    keys = df.filter("value IS NOT NULL").select(F.length("value").alias("n"), F.size(similarity.own_segments(F.col("value"))).alias("own"), F.size(similarity.probe_segments(F.col("value"))).alias("probe")).collect()
    assert all(x.own == 3 and x.probe <= 75 for x in keys)

    grams = {x.value: set(x.g) for x in df.filter("value IS NOT NULL").select("value", similarity.trigrams(F.col("value")).alias("g")).collect()}
    want = {(a, b): len(g & h) / len(g | h) for a, g in grams.items() for b, h in grams.items() if g & h and len(g & h) / len(g | h) >= 0.3}
    close = {(x.l, x.r): x.similarity for x in similarity.trigram_pairs(df, df).collect()}
    assert close.keys() == want.keys() and all(abs(close[k] - want[k]) < 1e-12 for k in want)
