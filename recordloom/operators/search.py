"""Fuzzy search: every row held against the few texts that a user types, then ranked by the similarity of its best field.

The texts are joined as a broadcast by a condition that no key expresses, so the join reads each row once, dealt out by id;
their number has a bound, beyond which they are asked in several calls.  `ngram_index` leaves out whole files before that.

Common subsequences are costly, so each candidate first gets a score that it cannot exceed, from the numbers of its characters.
The best rows by that, some times as many as are asked for, are scored; rows that cannot come up to the last of the best of
these are not in the result and are left out, all others are scored.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.functions import similarity, subsequence, text
from recordloom.session import scratch_path

FIELDS = ("name", "plate", "brand")
#: What is held against what, by field.
PAIRS = {"tel": ("q_tel", "tel_digits"), "plate": ("q_plate", "plate_norm"), "name": ("q_name", "name_norm"), "brand": ("q_brand", "brand_norm")}
#: Kept above a bound, so that rounding never puts it under the score.
SLACK = 1e-6
#: Rows that are scored for the first limit, for each row that is asked for: many have the same bound, so the best by it are not the best.
FIRST = 20
#: Texts of one call: they are broadcast, and each row is held against each.
MAX_TEXTS = 1_000


def asked(spark: SparkSession, texts: list[str]) -> DataFrame:
    """q, q_name, q_tel, q_plate, q_brand, kind of the texts that are long enough to search for."""
    if len(texts) > MAX_TEXTS:
        raise ValueError(f"{len(texts)} texts; {MAX_TEXTS} at most in one search")
    # The texts are here already, so they are composed here, and no Python worker is needed for them.
    rows = [(t, unicodedata.normalize("NFC", t)) for t in texts]
    q = spark.createDataFrame(rows, "q string, t string").withColumn("base", text.base(F.col("t"), False)).filter(F.length("base") >= 2)
    return q.select(
        "q",
        text.name(F.col("base"), False).alias("q_name"),
        text.phone(F.col("base"), False).alias("q_tel"),
        text.plate(F.col("base"), False).alias("q_plate"),
        text.brand(F.col("base"), False).alias("q_brand"),
        similarity.classify(F.col("base")).alias("kind"),
    )


def search(rows: DataFrame, texts: list[str], top: int = 20, threshold: float = 0.3, include_pending: bool = False) -> DataFrame:
    """Q, rank, id, score and match_on of the best rows for each search text.

    rows: id, name_norm, tel_digits, plate_norm, brand_norm, review_status, stored, created; only approved ones are found
    unless pending ones are asked for.  A row is a candidate by the similarity of 3-grams (at the threshold), by contained
    digits, or by a phone or plate within two edits.  Unlike the record system, no unordered cap cuts the candidates.
    """
    q = F.broadcast(asked(rows.sparkSession, texts).withColumns({f"qg_{f}": similarity.trigrams(F.coalesce(f"q_{f}", F.lit(""))) for f in FIELDS}).withColumns({f"qc_{f}": subsequence.counted(F.coalesce(c, F.lit(""))) for f, (c, _) in PAIRS.items()}))
    if not include_pending:
        rows = rows.filter("review_status = 'approved'")
    # A small file of many rows is one task's, so rows are dealt out before they are held against the texts.
    rows = rows.select("id", *(b for _, b in PAIRS.values()), "stored", "created").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    own = rows.withColumns({f"g_{f}": similarity.trigrams(F.coalesce(f"{f}_norm", F.lit(""))) for f in FIELDS})

    def alike(f: str):
        # The sets are compared once, and only if their sizes allow it: `need` is the least number of shared grams that gives the threshold.
        n = F.size(f"qg_{f}") + F.size(f"g_{f}")
        least = F.greatest(F.lit(1), F.ceil(threshold / (1 + threshold) * n - 1e-9).cast("int"))
        need = least + F.when(F.coalesce(F.try_divide(least, n - least) >= threshold, F.lit(False)), 0).otherwise(1)
        return (need <= F.least(F.size(f"qg_{f}"), F.size(f"g_{f}"))) & (F.size(F.array_intersect(f"qg_{f}", f"g_{f}")) >= need)

    def edited(a: str, b: str):
        return (F.col(a) != "") & (F.col(b) != "") & similarity.within(F.col(a), F.col(b), 2)

    # The cheap parts first: the others are not looked at where one holds.
    hit = ((F.col("q_tel") != "") & F.contains("tel_digits", "q_tel")) | edited("q_tel", "tel_digits") | edited("q_plate", "plate_norm") | alike("plate") | alike("brand") | alike("name")
    both = own.join(q, F.coalesce(hit, F.lit(False)))

    def scores(fields: list[str], score) -> list:
        """One expression over the pairs of the fields; a pair with an empty side scores 0."""
        pairs = F.array(*[F.struct(F.coalesce(PAIRS[f][0], F.lit("")).alias("a"), F.coalesce(PAIRS[f][1], F.lit("")).alias("b")) for f in fields])
        return F.transform(pairs, lambda p: F.when((p["a"] == "") | (p["b"] == ""), 0.0).otherwise(score(p["a"], p["b"])))

    def ranked(df: DataFrame) -> DataFrame:
        # Candidates gather where alike records stand, so they are dealt out anew before the costly part.
        dealt = df.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        scored = dealt.withColumn("parts", scores(["name", "brand"], subsequence.partial_ratio)).withColumn("wholes", scores(["tel", "plate"], subsequence.ratio))
        scored = scored.withColumn("sets", scores(["name"], subsequence.token_set_ratio))
        of = {
            "tel": F.when(held, 100.0).otherwise(F.get("wholes", F.lit(0))),
            "plate": F.get("wholes", F.lit(1)),
            "name": F.greatest(F.get("sets", F.lit(0)), F.get("parts", F.lit(0))),
            "brand": F.get("parts", F.lit(1)),
        }
        return scored.select("*", similarity.best_field(F.col("kind"), of).alias("best")).select("q", "id", "best.*", "stored", "created")

    held = (F.col("q_tel") != "") & F.contains("tel_digits", "q_tel")

    def most(f: str, score):
        a, b = (F.coalesce(c, F.lit("")) for c in PAIRS[f])
        return similarity.weight(F.col("kind"), f) * F.when((a == "") | (b == ""), 0.0).otherwise(score(F.col(f"qc_{f}"), a, b) + SLACK)

    def length_ratio(_, a, b):
        return 200.0 * F.least(F.length(a), F.length(b)) / (F.length(a) + F.length(b))

    shared = F.col("shared")
    name = most("name", lambda of, a, b: F.greatest(subsequence.most_token_set_ratio(of, a, b, shared), subsequence.most_partial_ratio(of, a, b, shared)))
    # Characters are counted only where the lengths let a field come over the name.
    fields = {
        "tel": (F.when(held, 0.0).otherwise(most("tel", length_ratio)), most("tel", subsequence.most_ratio)),
        "plate": (most("plate", length_ratio), most("plate", subsequence.most_ratio)),
        "brand": (most("brand", lambda *_: F.lit(100.0)), most("brand", subsequence.most_partial_ratio)),
    }
    over = [F.when(easy > F.col("most_name"), limit).otherwise(0.0) for easy, limit in fields.values()]
    over.append(F.when(held, similarity.weight(F.col("kind"), "tel") * (100.0 + SLACK)).otherwise(0.0))
    columns = [*(c for pair in PAIRS.values() for c in pair), "q", "kind", "id", "stored", "created"]
    # Columns of their own, as expressions with lambdas are worked out anew wherever they stand.
    named = both.withColumn("shared", subsequence.shared_characters(F.col("qc_name"), F.coalesce("name_norm", F.lit("")))).withColumn("most_name", name)
    bounded = named.select(*columns, F.bround(F.greatest("most_name", *over), 1).alias("most"))
    path = scratch_path(rows.sparkSession, "candidates")
    bounded.write.parquet(path)
    candidates = rows.sparkSession.read.schema(bounded.schema).parquet(path)
    first = candidates.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("most"), "id"))).filter(F.col("n") <= FIRST * top).drop("n")
    # The score of the top-th best of those: whatever cannot come up to it has that many rows before it.
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    least = ranked(first).select("q", "score", place.alias("n")).filter(F.col("n") == top).select("q", F.col("score").alias("least"))
    scored = ranked(candidates.join(F.broadcast(least), "q", "left").filter(F.col("least").isNull() | (F.col("most") >= F.col("least"))))
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.desc("stored"), F.desc("created"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("q", "rank", "id", "score", "match_on")
