"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the largest key filter: 2**27 bits are 16 MB, whatever the number of keys.
MAX_FILTER_LOG2 = 27
PAGE_BITS = 32768
#: Rows of a batch that goes to a Python worker.  Texts have some kilobytes each, and both sides hold a batch outside of the heap.
BATCH_ROWS = 1_000
#: Bytes of such a batch, beyond which it takes no further row: long texts come a few at a time.
BATCH_BYTES = 4_000_000


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's rows and bytes of an Arrow batch to BATCH_ROWS and BATCH_BYTES, if they are more."""
    for kind, most in (("Records", BATCH_ROWS), ("Bytes", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.max{kind}PerBatch"
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= most:
            spark.conf.set(name, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; it is installed on every machine and never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def free(name: str, *frames: DataFrame) -> str:
    """A column name like `name` that none of the frames has (in any case of letters)."""
    used = {c.lower() for df in frames for c in df.columns}
    while name.lower() in used:
        name = "_" + name
    return name


def join_hot(rows: DataFrame, groups: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined with groups (a row for each key, with its number of rows): keys of over a ten-thousandth of all rows, so fewer than 10,000, are broadcast, and no task takes such a key whole."""
    hot = groups.filter(F.col(n) > max(1_000, total // 10_000))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups, key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


class KeyFilter:
    """A one-hash Bloom filter of `keys` (a long column), built and probed with built-in functions only.

    It is kept as 4 KB bitmap pages.  Its size is at most 2**MAX_FILTER_LOG2 bits, so broadcasting it is
    safe at any number of keys; beyond that only the share of false positives grows.  `maybe` returns the
    rows whose key may be in the filter: never fewer than the true ones.
    """

    def __init__(self, keys: DataFrame, key: str, n_keys: int):
        self.log2 = max(15, min(MAX_FILTER_LOG2, (16 * max(1, n_keys)).bit_length()))
        slot = self._slot(F.col(key))
        self.pages = (
            keys.select(slot.alias("_s"))
            .groupBy(F.shiftright("_s", 15).alias("_page"))
            .agg(F.bitmap_construct_agg(F.col("_s").bitwiseAND(PAGE_BITS - 1)).alias("_bits"))
        )

    def saved(self) -> DataFrame:
        """The filter as rows to write: log2, _page, _bits."""
        return self.pages.select(F.lit(self.log2).alias("log2"), "_page", "_bits")

    @classmethod
    def of_pages(cls, saved: DataFrame) -> KeyFilter:
        out = cls.__new__(cls)
        first = saved.select("log2").first()
        out.log2, out.pages = first.log2 if first else 15, saved.drop("log2")
        return out

    def _slot(self, key: Column) -> Column:
        return F.xxhash64(key).bitwiseAND((1 << self.log2) - 1)

    def maybe(self, df: DataFrame, key: str) -> DataFrame:
        name = free("_maybe", df)
        return self.mark(df, key, name).filter(F.col(name)).drop(name)

    def mark(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """df with a boolean: whether the key may be in the filter."""
        slot = self._slot(F.col(key))
        pos = slot.bitwiseAND(PAGE_BITS - 1)
        at = F.shiftright(pos, 3).cast("int")
        page, bits = free("_page", df), free("_bits", df)
        byte = F.conv(F.hex(F.substring(F.col(bits), at + 1, F.lit(1))), 16, 10).cast("bigint")
        pages = self.pages.select(F.col("_page").alias(page), F.col("_bits").alias(bits))
        joined = df.withColumn(page, F.shiftright(slot, 15)).join(F.broadcast(pages), page, "left")
        return joined.withColumn(name, F.coalesce(F.getbit(byte, pos.bitwiseAND(7).cast("int")) == 1, F.lit(False))).drop(page, bits)
