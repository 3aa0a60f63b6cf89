"""Sharding by a Feistel permutation of global row numbers with cycle walking.

Rows are ordered by id and numbered from 0 without gaps; a keyed permutation of 0..n-1 maps the row number to
a place, shard = place mod shards and slot = place div shards.  Counts of shards differ by one at most, slots
are gapless, and shard and slot of a row number are computed without looking at any other row (`place_of`),
as is the row number at a shard and slot (`row_at`).

Numbers: a range exchange orders narrow rows (id, size, checksum), a checkpoint fixes the partitions, and
counts per partition (as many as there are partitions) give their offsets.  No task sees all rows.

Defined cases: null text has no bytes (size 1, checksum 0); repeated rows get places of their own; null ids
come first; an empty table gives no rows; other columns of the input are ignored.  Equal texts are not held
together: that and counts at most one apart exclude each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.session import cut

ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    """A published 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """A keyed permutation of 0..n-1: balanced Feistel network on the next even power of two, walked until inside."""

    def __init__(self, n: int, seed: int = 0):
        self.n, self.half = n, max(1, (max(1, n - 1).bit_length() + 1) // 2)
        self.keys = [_mix(np.array([seed * 1_000_003 + i + 1], dtype=np.uint64))[0] for i in range(ROUNDS)]

    def _pass(self, x: np.ndarray, keys: list, forward: bool) -> np.ndarray:
        h, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        a, b = x >> h, x & mask
        for k in keys:
            if forward:
                a, b = b, a ^ (_mix(b ^ k) & mask)
            else:
                a, b = b ^ (_mix(a ^ k) & mask), a
        return (a << h) | b

    def _walk(self, x: np.ndarray, keys: list, forward: bool) -> np.ndarray:
        x = self._pass(np.asarray(x, dtype=np.uint64), keys, forward)
        while (out := x >= self.n).any():
            x[out] = self._pass(x[out], keys, forward)
        return x.astype(np.int64)

    def place_of(self, row: np.ndarray) -> np.ndarray:
        return self._walk(row, self.keys, True)

    def row_at(self, place: np.ndarray) -> np.ndarray:
        return self._walk(place, self.keys[::-1], False)


def shard(docs: DataFrame, shards: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().bitwiseAND(1023).alias("_salt")
    )
    # The salt lets many repeats of one row fall into several ranges; equal rows are interchangeable.
    order = ["doc_id", "text_crc32", "size", "_salt"]
    ranged = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_salt"))
    numbered = ranged.withColumn("_m", F.monotonically_increasing_id())
    per = dict(numbered.groupBy(F.shiftright("_m", 33).alias("p")).count().collect())
    n, starts = 0, []
    for p in range(max(per, default=-1) + 1):
        starts.append(n)
        n += per.get(p, 0)
    perm = Permutation(n, seed)

    @F.pandas_udf("long")
    def place(row: pd.Series) -> pd.Series:
        return pd.Series(perm.place_of(row.to_numpy()))

    offset = F.get(F.lit(starts) if starts else F.array(F.lit(0)), F.shiftright("_m", 33).cast("int")).cast("bigint")
    out = numbered.withColumn("row_number", offset + F.col("_m").bitwiseAND((1 << 33) - 1)).drop("_m").withColumn("_place", place("row_number"))
    return out.select("doc_id", "size", "text_crc32", "row_number", (F.col("_place") % shards).cast("int").alias("shard"), F.expr(f"_place div {shards}").alias("slot"))
