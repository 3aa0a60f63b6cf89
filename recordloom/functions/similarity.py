"""String similarities: trigrams, edit distance and longest-common-subsequence ratios."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def words(c: Column) -> Column:
    """The lower-cased alphanumeric words, in order."""
    return F.filter(F.split(F.lower(c), r"(?U)[^\p{L}\p{N}]+"), lambda w: w != "")


def trigrams(c: Column) -> Column:
    """distinct 3-grams of each alphanumeric word, padded by two blanks before and one behind."""

    def of(w: Column) -> Column:
        p = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words(c), of)))


def trigram_pairs(left: DataFrame, right: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(l, r, similarity) over (id, value) frames, by an equi-join on the rare 3-grams of each side.

    Two sets of that similarity share one gram at least among the first of either, taken from the rarest on, without its last
    ceil(t * n) - 1 ones.  So a gram that many values have is joined only by values that have few others, and pairs of too
    different sizes are dropped before their sets are compared.
    """
    sides = [df.select("id", trigrams(F.col("value")).alias("g")).filter(F.size("g") > 0) for df in (left, right)]
    often = sides[0].unionByName(sides[1]).select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("often"))

    def first(df: DataFrame, side: str) -> DataFrame:
        ranked = df.select("id", F.explode("g").alias("gram")).join(often, "gram").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("x"))
        keep = F.size("x") - F.ceil(threshold * F.size("x") - 1e-9).cast("int") + 1
        return ranked.select(F.col("id").alias(side), F.transform("x", lambda e: e["gram"]).alias(f"g{side}"), F.explode(F.slice("x", F.lit(1), keep)).alias("k")).select(side, f"g{side}", F.col("k")["gram"].alias("gram"))

    a, b = first(sides[0], "l"), first(sides[1], "r")
    fits = (F.size("gl") >= threshold * F.size("gr") - 1e-9) & (F.size("gr") >= threshold * F.size("gl") - 1e-9)
    n = F.size(F.array_intersect("gl", "gr"))
    pairs = a.join(b, "gram").filter(fits).groupBy("l", "r").agg(F.first("gl").alias("gl"), F.first("gr").alias("gr"))
    return pairs.select("l", "r", (n / (F.size("gl") + F.size("gr") - n)).alias("similarity")).filter(F.col("similarity") >= threshold)


def within(a: Column, b: Column, most: int) -> Column:
    """edit distance of at most `most` (the three-argument form gives -1 beyond)."""
    return F.levenshtein(a, b, most).between(0, most)


def _segment(n: Column, i: Column, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of the i-th of even parts of n characters, the longer ones last."""
    whole, longer = F.floor(n / parts), n % parts
    before = F.greatest(i - (F.lit(parts) - longer), F.lit(0))
    return (i * whole + before).cast("int"), (whole + F.when(i >= F.lit(parts) - longer, 1).otherwise(0)).cast("int")


def own_segments(c: Column, most: int = 2) -> Column:
    """Keys (n, i, part) of a string: it is cut into one part more than there may be edits, so one of them stays as it is."""
    n = F.length(c)

    def key(i: Column) -> Column:
        start, size = _segment(n, i, most + 1)
        return F.struct(n.alias("n"), i.alias("i"), F.substr(c, start + 1, size).alias("part"))

    return F.transform(F.sequence(F.lit(0), F.lit(most)), key)


def probe_segments(c: Column, most: int = 2) -> Column:
    """Keys under which strings within `most` edits of c have a part: for each of their lengths and parts, what c has there, moved by as many places at most."""
    m = F.length(c)

    def of_part(n: Column, i: Column) -> Column:
        start, size = _segment(n, i, most + 1)
        places = F.filter(F.sequence(start - most, start + most), lambda p: (p >= 0) & (p + size <= m))
        return F.transform(places, lambda p: F.struct(n.alias("n"), i.alias("i"), F.substr(c, p + 1, size).alias("part")))

    def of_length(n: Column) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: of_part(n, i)))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.greatest(m - most, F.lit(0)), m + most), of_length)))


def edit_pairs(left: DataFrame, right: DataFrame, most: int = 2) -> DataFrame:
    """(l, r, distance) at edit distance 0 to `most`, over (id, value) frames; null values are near nothing.

    Candidates come from an equi-join on parts of strings (three a string on one side, at most 75 on the other, whatever their
    length), so no cross join is needed.
    """
    a = left.select(F.col("id").alias("l"), F.col("value").alias("vl"), F.explode(probe_segments(F.col("value"), most)).alias("k"))
    b = right.select(F.col("id").alias("r"), F.col("value").alias("vr"), F.explode(own_segments(F.col("value"), most)).alias("k"))
    pairs = a.join(b, "k").filter(within(F.col("vl"), F.col("vr"), most)).select("l", "r", "vl", "vr").distinct()
    return pairs.select("l", "r", F.levenshtein("vl", "vr").alias("distance"))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, in the JVM; for short strings."""
    chars = F.filter(F.split(a, ""), lambda x: x != "")
    other = F.filter(F.split(b, ""), lambda x: x != "")
    zero = F.transform(F.sequence(F.lit(0), F.length(b)), lambda i: F.lit(0))

    def row(prev: Column, ch: Column) -> Column:
        def cell(done: Column, i: Column) -> Column:
            value = F.when(F.get(other, i - 1) == ch, F.get(prev, i - 1) + 1).otherwise(F.greatest(F.get(prev, i), F.element_at(done, -1)))
            return F.concat(done, F.array(value))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0)).otherwise(F.element_at(F.aggregate(chars, zero, row), -1))


def ratio(a: Column, b: Column) -> Column:
    """200 * LCS / (sum of lengths); 100 for two empty strings."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(100.0)).otherwise(200.0 * lcs_length(a, b) / total)


# --- Python side, for long strings and for windows -------------------------------------------------


def _places(a: str) -> dict[str, int]:
    """For each character the bits of its places."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    return where


def _lcs(a: str, b: str, where: dict[str, int] | None = None) -> int:
    """Bit-parallel longest common subsequence; where: the places of a, if known."""
    where = _places(a) if where is None else where
    free = full = (1 << len(a)) - 1
    for ch in b:
        if ch in where:
            hit = free & where[ch]
            free = ((free + hit) | (free - hit)) & full
    return len(a) - free.bit_count()


def py_ratio(a: str, b: str) -> float:
    n = len(a) + len(b)
    return 200.0 * _lcs(a, b) / n if n else 100.0


def py_partial_ratio(a: str, b: str) -> float:
    """the best ratio of the shorter string with a window of the longer one, windows cut at its ends included."""
    if not a or not b:
        return 100.0 if a == b else 0.0

    def best(s: str, t: str) -> float:
        m, top, where = len(s), 0.0, _places(s)
        spans = [(i, i + m) for i in range(len(t) - m + 1)] + [(0, i) for i in range(1, m)] + [(len(t) - i, len(t)) for i in range(1, m)]
        for i, j in spans:
            if 200.0 * min(m, j - i) / (m + j - i) > top:
                top = max(top, 200.0 * _lcs(s, t[i:j], where) / (m + j - i))
        return top

    if len(a) == len(b):
        return max(best(a, b), best(b, a))
    return best(a, b) if len(a) < len(b) else best(b, a)


def py_token_set_ratio(a: str, b: str) -> float:
    """ratio of the sets of words; 100 if one holds the other."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_a, only_b = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_a or not only_b):
        return 100.0
    base, left, right = " ".join(both), " ".join(both + only_a), " ".join(both + only_b)
    scores = [py_ratio(left, right)]
    if both:
        scores += [py_ratio(base, left), py_ratio(base, right)]
    return max(scores)


def _pairwise(f):
    @F.pandas_udf(T.DoubleType())
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        # Columns of few values repeat their pairs; each is scored once a batch.
        pairs = list(zip(a, b, strict=True))
        score = {p: f(p[0] or "", p[1] or "") for p in set(pairs)}
        return pd.Series([score[p] for p in pairs], dtype="float64")

    return udf


ratio_udf = _pairwise(py_ratio)
partial_ratio = _pairwise(py_partial_ratio)
token_set_ratio = _pairwise(py_token_set_ratio)
name_score = _pairwise(lambda a, b: max(py_token_set_ratio(a, b), py_partial_ratio(a, b)))


def classify(q: Column) -> Column:
    """what a search text looks like: tel, plate or name.  Digits are those of the text, as it was typed."""
    tight = F.replace(q, F.lit(" "), F.lit(""))
    digits = F.regexp_replace(q, r"(?U)\D", "")
    return (
        F.when((F.length(digits) >= 6) & (F.length(digits) >= F.length(tight) - 2), F.lit("tel"))
        .when(tight.rlike("[ก-ฮ]") & tight.rlike(r"(?U)\d") & (F.length(tight) <= 10), F.lit("plate"))
        .otherwise(F.lit("name"))
    )


#: F25, fixed values: weight of a field's similarity by what the text looks like; ties go to the first field.
WEIGHTS = {
    "tel": {"tel": 1.0, "plate": 0.85, "name": 0.80, "brand": 0.60},
    "plate": {"tel": 0.85, "plate": 1.0, "name": 0.80, "brand": 0.60},
    "name": {"tel": 0.80, "plate": 0.85, "name": 1.0, "brand": 0.70},
}


def weight(kind: Column, field: str) -> Column:
    """the weight of one field."""
    return F.when(kind == "tel", WEIGHTS["tel"][field]).when(kind == "plate", WEIGHTS["plate"][field]).otherwise(WEIGHTS["name"][field])


def best_field(kind: Column, scores: dict[str, Column]) -> Column:
    """struct(score, match_on) of the field with the largest weighted similarity."""
    table = F.create_map(*[x for k, w in WEIGHTS.items() for x in (F.lit(k), F.array(*[F.lit(w[f]) for f in scores]))])
    ranked = F.array(*[F.struct((s * F.get(F.element_at(table, kind), F.lit(i))).alias("v"), F.lit(-i).alias("o"), F.lit(f).alias("f")) for i, (f, s) in enumerate(scores.items())])
    top = F.array_max(ranked)
    return F.struct(F.bround(top["v"], 1).alias("score"), top["f"].alias("match_on"))
