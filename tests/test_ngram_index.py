"""The persisted n-gram index: the same rows as without it, from fewer files."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.functions import similarity
from recordloom.operators import filters
from recordloom.operators import ngram_index as N
from recordloom.operators.search import MAX_TEXTS, search

SCHEMA = "id int, name_norm string, tel_digits string, plate_norm string, brand_norm string, review_status string, stored boolean, created int"


def _rows(seed, n, start=0):
    r = random.Random(seed)
    first, last = ["ann", "bob", "cyril", "dora", "somchai", "สมชาย"], ["smith", "jones", "jaidee", "σίγμας"]
    return [
        (start + i, f"{r.choice(first)} {r.choice(last)} {r.randrange(50)}", r.choice(["08" + "".join(r.choice("0123456789") for _ in range(8)), None, ""]), r.choice([f"{r.randrange(9)}กก{r.randrange(9999)}", None]),
         r.choice(["toyota", "honda", None]), r.choice(["approved", "approved", "pending"]), r.random() < 0.5, r.randrange(9))
        for i in range(n)
    ]


def _index(spark, folder, rows, files):
    spark.createDataFrame(rows, SCHEMA).repartitionByRange(files, "name_norm").write.mode("append").parquet(f"{folder}/rows")
    return N.NgramIndex(spark, f"{folder}/rows", f"{folder}/index", ["name_norm", "plate_norm", "brand_norm"], ["name_norm", "plate_norm", "tel_digits"], buckets=4)


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    rows = [*_rows(1, 120), (500, "quixote vandermeer", "0811111111", "1กก1", None, "approved", True, 3)]
    index = _index(spark, str(tmp_path_factory.mktemp("n")), rows, 8)
    assert len(index.update()) == 8 and index.update() == []
    return index, rows


def test_same_rows_as_without(spark, indexed):
    index, rows = indexed
    df = spark.createDataFrame(rows, SCHEMA)
    phone, plate = next(x[2] for x in rows if x[2]), next(x[3] for x in rows if x[3])
    texts = ["dora jaidee 7", phone, phone[3:6], phone[:4] + "9" + phone[5:], plate, plate[1:], "σίγμας", "ΣΊΓΜΑΣ", "toyot", "quixote vandermer", "wvxyz qjkhf", "x"]
    for some, pending in ((texts, False), (texts[:4], True), (["quixote vandermer"], False)):
        want = {tuple(x) for x in search(df, some, top=9, include_pending=pending).collect()}
        assert {tuple(x) for x in index.search(some, top=9, include_pending=pending).collect()} == want and len({x[0] for x in want}) >= min(7, len(some))


def test_files_are_skipped(indexed):
    index, _ = indexed
    kept = index.prune(index.search_conditions(["quixote vandermer"]))
    assert len(kept.paths) == 1 and kept.total == 8
    assert index.prune(index.search_conditions(["wvxyz qjkhf"])).paths == []
    assert index.rows(index.prune(index.search_conditions(["wvxyz qjkhf"]))).count() == 0
    assert index.prune([]).paths == []


def test_conditions_are_necessary(spark, indexed):
    """Every file with a row that fits is kept, for each kind of condition alone."""
    index, rows = indexed
    r = random.Random(5)
    of_file = {}
    for x in spark.read.parquet(index.rows_folder).withColumn("f", F.col("_metadata.file_name")).collect():
        of_file.setdefault(x.f, []).append(x)
    for _ in range(6):
        tel = r.choice([x[2] for x in rows if x[2]])
        near = list(tel)
        near[r.randrange(10)] = r.choice("0123456789")
        near.insert(r.randrange(10), "5")
        q, part = "".join(near), tel[2 : 2 + r.randrange(1, 6)]
        names = lambda p: {x.rsplit("/", 1)[1] for x in p.paths}
        assert {f for f, xs in of_file.items() if any(part in (x.tel_digits or "") for x in xs)} <= names(index.prune([N.holds("tel_digits", [part])]))
        assert {f for f, xs in of_file.items() if any(x.tel_digits == tel for x in xs)} <= names(index.prune([N.edited("tel_digits", q)]))


def test_search_box(spark, indexed):
    index, rows = indexed
    for name, digits in (("ora jai", "00"), ("nn%smi_h", "12345"), ("สมชาย", ""), ("100%", "0812"), ("DORA", "")):
        predicate = filters.search_box(digits, {"name_norm": name}, "tel_digits")
        pruned = index.box({"name_norm": name, **({"tel_digits": digits} if digits else {})})
        got = {x.id for x in index.rows(pruned).filter(predicate).collect()}
        assert got == {x.id for x in spark.createDataFrame(rows, SCHEMA).filter(predicate).collect()}
    assert len(index.box({"name_norm": "dora jaidee"}).paths) < 8


def test_grams_of_a_file_are_those_of_its_rows(spark, indexed, tmp_path, monkeypatch):
    """Against plain Python and the search's own 3-grams, with blanks, line ends, signs and characters beyond 16 bits; also where a task gives its grams out in between."""
    odd = [None, "", "a", " a  b", "x\ny z", "é-É", "😀a😀b", "กก1", "\0ab", "..", "ab\tab"]
    rows = [(i, t, t, t, t, "approved", True, 1) for i, t in enumerate(odd)] + _rows(3, 60, 100)
    for k, most in enumerate((N.KEPT, 1)):
        index = _index(spark, str(tmp_path / str(k)), rows, 3)
        own = index.spark.read.parquet(index.rows_folder).select("*", F.col("_metadata.file_name").alias("f")).collect()
        want = set()
        for x in own:
            for c in index.plains:
                t = (x[c] or "").lower()
                want |= {("plain", c, g, x.f) for n in (1, 2, 3) for g in N.plain_grams(t, n)}
        for c in index.words:
            of = spark.read.parquet(index.rows_folder).select(F.col("_metadata.file_name").alias("f"), F.explode(similarity.trigrams(F.coalesce(c, F.lit("")))).alias("g"))
            want |= {("word", c, x.g, x.f) for x in of.collect()}
        monkeypatch.setattr(N, "KEPT", most)
        index.update()
        got = [(x.kind, x.column, x.gram, x.file) for x in spark.read.parquet(index.postings_folder).collect()]
        assert len(got) == len(set(got)) and want == set(got)


def test_distinct_grams():
    for n in (1, 2, 3):
        for texts in ([], [""], ["a"], ["", "ab", "", "abc", "😀\0b"], ["abab", "baba"]):
            assert sorted(N.unpacked(N.distinct_grams(texts, n), n)) == sorted(set().union(*[N.plain_grams(t, n) for t in texts]))


def test_updates(spark, tmp_path):
    folder = str(tmp_path)
    index = _index(spark, folder, _rows(2, 30), 3)
    one = [(900, "zebra crossing", "0899999999", None, None, "approved", True, 1)]
    assert len(index.prune(index.search_conditions(["zebra crossing"])).paths) == 3  # nothing is indexed yet
    index.update()
    assert index.search(["zebra crossing"]).count() == 0
    _index(spark, folder, one, 1)
    assert [x.id for x in index.search(["zebra crossing"]).collect()] == [900]  # found before it is indexed
    assert len(index.update()) == 1
    kept = index.prune(index.search_conditions(["zebra crossing"]))
    assert len(kept.paths) == 1 and kept.total == 4 and [x.id for x in index.search(["zebra crossing"]).collect()] == [900]


def test_bound_of_texts(spark, indexed):
    with pytest.raises(ValueError):
        search(spark.createDataFrame(indexed[1], SCHEMA), ["ab"] * (MAX_TEXTS + 1))
