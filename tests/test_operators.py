"""Invariants of the record operators on small tables."""

import random
import re

from pyspark.sql import functions as F

from recordloom.functions import similarity, text
from recordloom.operators import duplicates, metrics, mutate, visits, workqueue
from recordloom.operators.graph import connected_components
from recordloom.operators.search import search
from recordloom.sources import readers
from recordloom.streaming.ingest import NoCrop, Retryable, StubExtractor, extract, with_retries
from recordloom.streaming.queue import QueueFold
from recordloom.streaming.state import ThrottleFold


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_groups_are_transitive_and_nulls_never_link(spark):
    rows = [("a", "H1", "k1"), ("b", "H1", "k2"), ("c", "H2", "k2"), ("d", None, None), ("e", None, None), ("f", "H9", "k9")]
    df = spark.createDataFrame(rows, "id string, h string, k string")
    e = duplicates.key_edges(df, "id", {"img": F.col("h"), "txt": F.col("k")})
    assert {r.id: r.component for r in duplicates.groups(e).collect()} == {"a": "a", "b": "a", "c": "a"}


def test_visits(spark):
    rows = [(1, "p", "2026-09-10"), (2, "p", "2026-09-11"), (3, "p", "2026-09-11"), (4, "p", None), (5, "q", "2026-09-10")]
    df = spark.createDataFrame(rows, "id long, plate string, day string").withColumn("day", F.col("day").cast("date"))
    got = {r.id: (r["round"], r.dup, r.total) for r in visits.numbered(df, "plate", visits.visit_key(F.col("day"), F.col("id"))).collect()}
    assert got == {1: (1, 1, 3), 2: (2, 2, 3), 3: (2, 2, 3), 4: (3, 1, 3), 5: (1, 1, 1)}


def test_date_health_partitions_all_rows(spark):
    df = spark.range(900).select(F.when(F.col("id") % 50 != 0, F.date_sub(F.lit("2026-09-26").cast("date"), F.col("id").cast("int") - 20)).alias("d"))
    r = metrics.coverage(metrics.date_health(df, F.col("d"), "2026-09-26")).first()
    assert r.no_date + r.odd + r.older + r.in_window == 900 and r.outside == 900 - r.in_window


def test_guarded_first_writer(spark):
    state = spark.createDataFrame([(1, "stored"), (2, "returned"), (3, "stored")], "id long, car string")
    commands = spark.createDataFrame([(1, 2, "late"), (1, 1, "first"), (2, 1, "no")], "id long, seq int, who string")
    got = {r.id: (r.car, r.who2, r.applied) for r in mutate.guarded(state, commands, "id", ["seq"], F.col("car") == "stored", {"car": F.lit("returned"), "who2": F.col("who")}).collect()}
    assert got == {1: ("returned", "first", True), 2: ("returned", None, False), 3: ("stored", None, False)}


def test_delete_resets_pointers(spark):
    s = spark.createDataFrame([(1, None), (2, 1), (3, 2)], "id long, sup long")
    out = mutate.delete(s, spark.createDataFrame([(1,)], "id long"), "id", {"img": (spark.createDataFrame([(1,), (2,)], "ref long"), "ref")}, "sup")
    assert {(r.id, r.sup) for r in out["state"].collect()} == {(2, None), (3, 2)} and [r.ref for r in out["img"].collect()] == [2]


def test_queue_assignments_are_distinct(spark):
    q = spark.range(50).select(F.col("id").alias("rec"))
    w = spark.createDataFrame([(f"w{i}",) for i in range(7)], "worker string")
    got = workqueue.assign(q, w, "rec", [F.col("rec").asc()], 7).collect()
    assert len({r.worker for r in got}) == len({r.rec for r in got}) == 7 and {r.rec for r in got} == set(range(7))


def test_throttle_fold():
    f = ThrottleFold()
    assert [f.step(t, False) for t in range(5)] == [(False, 0)] * 4 + [(False, 30)]
    assert f.step(10, False) == (True, 0) and f.step(34, False) == (False, 60)
    assert f.step(95, True) == (False, 0) and f.step(96, False) == (False, 0)


def test_queue_fold_leases():
    q = QueueFold()
    q.step(0, "add", "", "a")
    q.step(1, "add", "", "b", True)
    assert q.step(2, "claim_next", "x", "") == "b" and q.step(3, "claim_next", "y", "") == "a"
    assert q.step(4, "claim_one", "y", "b") == "x" and q.step(700, "claim_one", "y", "b") == "b"
    assert q.step(701, "claim_next", "x", "") == "a"


def test_retries_never_raise():
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise Retryable("429")
        return {"fields": {}}

    assert with_retries(flaky, wait=waits.append)["error"] is None and waits == [1.0, 2.0]
    assert "ValueError" in with_retries(lambda: int("x"))["error"]


def test_extract_isolates_failures_and_falls_back(spark):
    class Half(NoCrop):
        def crop(self, image):
            return b'{"fields": {}, "cost": 1}'

    files = spark.createDataFrame([("h1", bytearray(b"not json")), ("h2", bytearray(b'{"fields": {"tel": "08"}, "cost": 2}'))], "sha256 string, content binary")
    got = {r.sha256: r for r in extract(files, StubExtractor(), Half()).collect()}
    assert got["h2"].used == "full" and got["h2"].cost == 3 and got["h1"].used == "crop"
    plain = {r.sha256: r for r in extract(files, StubExtractor()).collect()}
    assert plain["h1"].error and plain["h2"].error is None


def test_scripts_and_config(tmp_path):
    sql = "-- a; b\nCREATE TABLE x (a int); INSERT INTO x VALUES (';'); DO $t$ a; b $t$;\n"
    assert list(readers.split_statements(sql)) == ["CREATE TABLE x (a int)", "INSERT INTO x VALUES (';')", "DO $t$ a; b $t$"]
    assert readers.env_config({"A": "1", "B": "x, y"}, {"A": "2"}) == {"A": "2", "B": ["x", "y"]}


def test_markdown(spark):
    from recordloom.operators.report import markdown

    df = spark.createDataFrame([("a|b", 0.5, None), ("c", 2.0, 3)], "k string, v double, n int")
    assert markdown(df) == "| k | v | n |\n|-|-|-|\n| a\\|b | 0.5 | n/a |\n| c | 2 | 3 |\n"


def _grams(t):
    words = re.findall(r"[^\W_]+", t.lower())
    return {p[i : i + 3] for w in words for p in [f"  {w} "] for i in range(len(p) - 2)}


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


def _partial(a, b):
    s, t = sorted((a, b), key=len)
    turns = [(s, t), (t, s)] if len(s) == len(t) else [(s, t)]
    return max(_ratio(x, y[i:j]) for x, y in turns for i in range(-len(x) + 1, len(y)) for j in [min(len(y), i + len(x))] for i in [max(0, i)] if j > i)


def _ratio(a, b):
    return 200 * _lcs(a, b) / (len(a) + len(b))


def _sets(a, b):
    x, y = set(a.split()), set(b.split())
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x & y) + sorted(x - y)), " ".join(sorted(x & y) + sorted(y - x))
    if not x or not y:
        return 0
    if both and (x <= y or y <= x):
        return 100
    return max([_ratio(left, right)] + ([_ratio(both, left), _ratio(both, right)] if both else []))


def test_search_against_brute_force(spark):
    r = random.Random(6)
    first, last = ["ann", "bob", "cyril", "dora", "somchai"], ["smith", "jones", "jaidee", "smit"]
    rows = []
    for i in range(80):
        tel = "08" + "".join(r.choice("0123") for _ in range(8))
        rows.append((i, f"{r.choice(first)} {r.choice(last)}", r.choice([tel, tel, None, ""]), r.choice([f"1กก{r.randrange(30)}", None]), r.choice(["toyota", "honda", None]), r.choice(["approved", "pending"]), r.random() < 0.5, r.randrange(9)))
    phones = [x[2] for x in rows if x[2] and x[5] == "approved"]
    texts = ["somchai", "smith ann", phones[0], "+66 " + phones[1][1:], phones[2][4:7], "1กก7", "honda", "x", "  ", "0" + phones[3][2:], "812 345 67"]
    df = spark.createDataFrame(rows, "id int, name_norm string, tel_digits string, plate_norm string, brand_norm string, review_status string, stored boolean, created int")
    qs = spark.createDataFrame([(t,) for t in texts], "q string").select(
        "q", text.base(F.col("q")).alias("b"), *[f(text.base(F.col("q"))).alias(n) for n, f in (("name", text.name), ("tel", text.phone), ("plate", text.plate), ("brand", text.brand))]
    ).collect()
    for pending in (False, True):
        want = set()
        for q in qs:
            if len(q.b) < 2:
                continue
            digits, tight = re.sub(r"\D", "", q.b), q.b.replace(" ", "")
            kind = "tel" if len(digits) >= 6 and len(digits) >= len(tight) - 2 else "plate" if re.search("[ก-ฮ]", q.b) and re.search(r"\d", q.b) and len(tight) <= 10 else "name"
            found = []
            for i, name, tel, plate, brand, status, stored, created in rows:
                if status != "approved" and not pending:
                    continue
                tel, plate, brand = tel or "", plate or "", brand or ""
                like = lambda a, b: bool(_grams(a) & _grams(b)) and len(_grams(a) & _grams(b)) / len(_grams(a) | _grams(b)) >= 0.3
                if not (like(name, q["name"] or "") or like(plate, q.plate or "") or like(brand, q.brand or "") or q.tel and (q.tel in tel or tel and _edits(tel, q.tel) <= 2) or q.plate and plate and _edits(plate, q.plate) <= 2):
                    continue
                s = {
                    "tel": (100 if q.tel in tel else _ratio(q.tel, tel)) if q.tel and tel else 0,
                    "plate": _ratio(q.plate, plate) if q.plate and plate else 0,
                    "name": max(_sets(q["name"], name), _partial(q["name"], name)) if q["name"] and name else 0,
                    "brand": _partial(q.brand, brand) if q.brand and brand else 0,
                }
                on = max(s, key=lambda f: s[f] * similarity.WEIGHTS[kind][f])
                found.append((-round(s[on] * similarity.WEIGHTS[kind][on], 1), not stored, -created, i, on))
            want |= {(q.q, k + 1, i, -v, on) for k, (v, _, _, i, on) in enumerate(sorted(found)[:7])}
        got = {(x.q, x["rank"], x.id, x.score, x.match_on) for x in search(df, texts, top=7, include_pending=pending).collect()}
        assert got == want and len({x[0] for x in got}) >= 8


def test_classify_counts_the_digits_that_were_typed(spark):
    q = spark.createDataFrame([("+66 812-345678",), ("12345",), ("081 234",), ("กข 12",), ("ann 123456789",)], "q string")
    assert [x.k for x in q.select(similarity.classify(F.col("q")).alias("k")).collect()] == ["tel", "name", "tel", "plate", "name"]
