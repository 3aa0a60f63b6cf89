"""Benchmark decontamination by winnowing (built-in functions only).

Fingerprints are the minima of xxhash64 over K consecutive words in each window of span - K + 1 such grams, where span
is SPAN or the words of the shortest item of at least K words, if that has fewer; a run of span equal words in a document
and an item therefore always shares a fingerprint, and so does every window of an item.  Items of fewer than K words
have the hash of all their words as fingerprint, and documents those of so many consecutive ones, for each such length.

Each document is read once for its number of words and its fingerprints, a narrow table.  Fingerprints of both sides are
joined, and only documents with a shared one are looked at again: every shared gram is a diagonal (document position minus
item position), along which words are compared one by one; runs of SPAN equal words (or of all words of a shorter item)
are hits.  Hashes only propose, words decide.

Defined cases: null text has no words; very long texts are read whole, in one row; an item without words has no window;
repeated items count once by item_id, a null item_id is an item of its own; rows that repeat an id are judged by their own
text, null ids too; an empty benchmark or table gives zeros or no rows; other columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import KeyFilter
from recordloom.session import cut

SPAN = 13
K = 5
#: What separates words, after A-Z are lower-cased.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Benchmarks up to this many fingerprints are broadcast (16 bytes each); larger ones are joined by shuffle.
MAX_BROADCAST_FINGERPRINTS = 500_000


def words(text: Column) -> Column:
    """Words in order.  Splitting costs a fifth of extracting every match."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), BREAK), "")


def word_hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def grams(hw: Column, k: int = K) -> Column:
    """Hash of each k consecutive word hashes; empty if there are fewer."""
    n = F.size(hw)
    at = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(hw, i + j) for j in range(k)]))


def fingerprints(gram: Column, span: int = SPAN, k: int = K) -> Column:
    """Distinct minima over windows of span - k + 1 grams (of all of them, if fewer)."""
    w = span - k + 1
    n = F.size(gram)
    at = F.sequence(F.lit(1), F.greatest(n - (w - 1), F.lit(1)))
    return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.transform(at, lambda i: F.array_min(F.slice(gram, i, F.lit(w))))))


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """item_row (a number), item_id, iw (words), hw (their hashes); one row for each distinct (item, text) that has words."""
    b = benchmark.select(F.col(item_col).cast("string").alias("item_id"), words(F.col(text_col)).alias("iw")).filter(F.size("iw") > 0).dropDuplicates(["item_id", "iw"])
    return b.select(F.monotonically_increasing_id().alias("item_row"), "item_id", "iw", word_hashes(F.col("iw")).alias("hw"))


def _grams_of(hw: Column, n_item: Column, tiny: list[int]) -> Column:
    """Grams that belong to an item of n_item words: of K words, or of all of them."""
    out = grams(hw)
    for m in tiny:
        out = F.when(n_item == m, grams(hw, m)).otherwise(out)
    return out


def _maybe_broadcast(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= MAX_BROADCAST_FINGERPRINTS else df


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hit_positions(dw: Column, dg: Column, iw: Column, ig: Column, anchors: Column, span: int) -> Column:
    """Positions of document words inside a window of the item: extension of every shared gram along its diagonal."""
    n_item = F.size(iw)
    need = F.least(F.lit(span), n_item)
    p_at = F.filter(F.transform(dg, lambda g, p: F.struct(g.alias("g"), p.alias("p"))), lambda x: F.array_contains(anchors, x["g"]))
    q_at = F.filter(F.transform(ig, lambda g, q: F.struct(g.alias("g"), q.alias("q"))), lambda x: F.array_contains(anchors, x["g"]))

    def diagonals(qs: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(p_at, lambda x: F.transform(F.filter(qs, lambda y: y["g"] == x["g"]), lambda y: x["p"] - y["q"]))))

    def run(d: Column) -> Column:
        same = F.array_join(F.transform(iw, lambda w, i: F.when((d + i >= 0) & w.eqNullSafe(F.get(dw, d + i)), F.lit("1")).otherwise(F.lit("0"))), "")

        def spans(flags: Column) -> Column:
            starts = F.filter(F.sequence(F.lit(0), n_item - need), lambda i: F.substr(flags, i + 1, need) == F.repeat(F.lit("1"), need))
            return F.flatten(F.transform(starts, lambda i: F.sequence(d + i, d + i + need - 1)))

        return _let(same, spans)

    return F.array_distinct(F.flatten(F.transform(_let(q_at, diagonals), run)))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, item_ids (sorted), hit_at (sorted word positions), text_sha256, contaminated (a twentieth of its words or more are hit)."""
    items = cut(_items(benchmark, item_col, item_text_col))
    n_item = F.size("iw")
    few = items.agg(F.min(F.when(n_item >= K, n_item)).alias("least"), F.array_sort(F.collect_set(F.when(n_item < K, n_item))).alias("tiny")).first()
    width, tiny = min(span, few["least"] or span), list(few["tiny"])
    items = items.withColumn("g", _grams_of(F.col("hw"), n_item, tiny))
    items = cut(items.select("item_row", "item_id", "iw", "g", F.when(n_item < K, F.col("g")).otherwise(fingerprints(F.col("g"), width)).alias("anchors")))
    index = items.select(F.explode("anchors").alias("h"), "item_row").distinct()
    n_anchors = index.count()

    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("digest", F.unhex(F.sha2("text", 256)))
    hashed = base.select("doc_id", "digest", words(F.col("text")).alias("dw")).select("doc_id", "digest", F.size("dw").cast("bigint").alias("n_words"), word_hashes(F.col("dw")).alias("hw"))
    none = [F.lit(0).cast("bigint").alias("n_hit"), F.lit(0).cast("bigint").alias("n_items"), F.array().cast("array<string>").alias("item_ids"), F.array().cast("array<int>").alias("hit_at")]
    if not n_anchors:
        out = hashed.select("doc_id", "n_words", *none, F.lower(F.hex("digest")).alias("text_sha256"))
    else:
        marks = ([_let(grams(F.col("hw")), lambda g: fingerprints(g, width))] if few["least"] else []) + [grams(F.col("hw"), m) for m in tiny]
        read = cut(hashed.select("doc_id", "digest", "n_words", F.array_distinct(F.concat(*marks)).alias("marks")))
        pairs = read.select("doc_id", "digest", F.explode("marks").alias("h")).join(_maybe_broadcast(index, n_anchors), "h")
        pairs = cut(pairs.select("doc_id", "digest", "item_row").distinct())
        key = F.xxhash64("doc_id", "digest")
        wanted = KeyFilter(pairs.select(key.alias("k")), "k", pairs.count())
        again = wanted.maybe(base.withColumn("k", key), "k").drop("k").dropDuplicates(["doc_id", "digest"])
        joined = (
            again.join(pairs, on=[again.doc_id.eqNullSafe(pairs.doc_id), again.digest == pairs.digest])
            .select(again.doc_id, again.digest, "text", "item_row")
            .join(items, "item_row")
            .withColumn("dw", words(F.col("text")))
            .drop("text")
        )
        joined = joined.withColumn("dh", word_hashes(F.col("dw"))).withColumn("dg", _grams_of(F.col("dh"), n_item, tiny))
        at = joined.select("doc_id", "digest", "item_id", hit_positions(F.col("dw"), F.col("dg"), F.col("iw"), F.col("g"), F.col("anchors"), span).alias("at"))
        # No filter on a computed array here: it would be pushed below the projections and compute them again and again.
        found = at.groupBy("doc_id", "digest").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("hit_at"),
            F.array_sort(F.collect_set(F.when(F.size("at") > 0, F.coalesce("item_id", F.lit(""))))).alias("item_ids"),
        )
        j = read.join(found, on=[read.doc_id.eqNullSafe(found.doc_id), read.digest == found.digest], how="left")
        out = j.select(
            read.doc_id,
            "n_words",
            F.coalesce(F.size("hit_at"), F.lit(0)).cast("bigint").alias("n_hit"),
            F.coalesce(F.size("item_ids"), F.lit(0)).cast("bigint").alias("n_items"),
            F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
            F.coalesce("hit_at", F.array().cast("array<int>")).alias("hit_at"),
            F.lower(F.hex(read.digest)).alias("text_sha256"),
        )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
