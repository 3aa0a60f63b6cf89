"""Removal of rows by key, without shuffling the rows that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import KeyFilter, free
from recordloom.session import cut


def keep_rows(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that `dropped` names by doc_id or, if it has a column digest too, by doc_id and SHA-256 of the text.

    A bounded key filter lets most rows that stay pass by; only the others take part in the anti-join.  With
    a digest, one of repeated rows (same id and text) stays for each that is not named.

    Defined cases: null text counts as empty; a null id is an id like any other; an empty `dropped` keeps all rows, an
    empty table has none; columns of docs keep their names and values, whatever they are called.
    """
    by_digest = "digest" in dropped.columns
    ident, digest, times, key, maybe = (free(n, docs) for n in ("_id", "_digest", "_times", "_k", "_maybe"))
    d = dropped.select(F.col("doc_id").alias(ident), *([F.col("digest").alias(digest)] if by_digest else []))
    keys = [ident, *([digest] if by_digest else [])]
    d = cut(d.groupBy(*keys).agg(F.count(F.lit(1)).alias(times)))
    own = docs.withColumn(ident, F.col(id_col))
    if by_digest:
        own = own.withColumn(digest, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    marked = KeyFilter(d.select(F.xxhash64(*keys).alias("k")), "k", d.count()).mark(own.withColumn(key, F.xxhash64(*keys)), key, maybe)
    stay = marked.filter(~F.col(maybe)).select(*docs.columns)
    some = marked.filter(F.col(maybe))
    named = [free(f"{k}_of", docs) for k in keys]
    d = d.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], times)
    checked = some.join(d, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, named, strict=True)], "left").drop(*named)
    gone = checked.filter(F.col(times).isNull()).select(*docs.columns)
    if not by_digest:
        return stay.unionByName(gone)
    # Equal rows: all but as many as are named stay; they are alike, so which ones does not matter.
    rest = checked.filter(F.col(times).isNotNull()).groupBy(*keys, *[F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)], times).agg(F.count(F.lit(1)).alias("n"))
    left = F.col("n") - F.col(times)
    rest = rest.withColumn("i", F.explode(F.when(left > 0, F.sequence(F.lit(1).cast("bigint"), left)).otherwise(F.array().cast("array<bigint>"))))
    return stay.unionByName(gone).unionByName(rest.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)]))
