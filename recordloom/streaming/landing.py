"""Ingest of a landing stream, exactly once.

A batch of the stream is written in steps, each to a folder of its number: the reads, which cost money and are kept if they are
whole; records and skipped files; and last its commit, one row.  Only batches with a commit count, for readers and for the gate
of later batches, so a batch that broke off anywhere is done again in the same folders, and one that was committed is passed
over when the stream offers it again.

Defined cases: an empty batch commits nothing to read; equal files of one batch or of different ones give one record, the first;
a store without commits has no records.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.streaming.ingest import Extractor, Preprocessor, ingest

#: Columns of the binary file source.
BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
_IMAGES = "sha256 string, record string, created bigint"
_OPEN = "plate_norm string, tel_digits string"


def binary_files(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """path, content of the files that land in a folder, as a stream."""
    return spark.readStream.schema(BINARY_FILE).format("binaryFile").options(**options).load(folder).select("path", "content")


class Store:
    """Tables of a landing ingest under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _there(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def place(self, table: str, batch: int) -> str:
        return f"{self.folder}/{table}/batch={batch}"

    def whole(self, table: str, batch: int) -> bool:
        return self._there(f"{self.place(table, batch)}/_SUCCESS")

    def write(self, df: DataFrame, table: str, batch: int) -> DataFrame:
        """What a batch gives to a table; what is left of an attempt that broke off goes."""
        df.write.mode("overwrite").parquet(self.place(table, batch))
        return self.spark.read.parquet(self.place(table, batch))

    def once(self, df: DataFrame, table: str, batch: int) -> DataFrame:
        """Written unless an earlier attempt has written the whole of it."""
        return self.spark.read.parquet(self.place(table, batch)) if self.whole(table, batch) else self.write(df, table, batch)

    def table(self, name: str) -> DataFrame | None:
        """Rows of the committed batches, with a column batch; None if there are none."""
        if not self._there(f"{self.folder}/commits"):
            return None
        # Batches are committed in their order; a later one, which may be half there, is left out before files are read.
        last = self.spark.read.parquet(f"{self.folder}/commits").agg(F.max("batch")).first()[0]
        return self.spark.read.option("mergeSchema", "true").parquet(f"{self.folder}/{name}").filter(F.col("batch") <= last)


def ingest_batch(store: Store, files: DataFrame, batch: int, extractor: Extractor, as_of_year: int, preprocessor: Preprocessor | None = None) -> None:
    """One batch (path, content): nothing if it is committed, all of it otherwise."""
    if store.whole("commits", batch):
        return
    spark = store.spark
    before = store.table("records")
    if before is None:
        known, open_ = spark.createDataFrame([], _IMAGES), spark.createDataFrame([], _OPEN)
    else:
        images = before.select("sha256", "processed", "batch")
        known = images.select(F.explode(F.array_distinct(F.array("sha256", "processed"))).alias("image"), "sha256", "batch").select(F.col("image").alias("sha256"), F.col("sha256").alias("record"), F.col("batch").cast("bigint").alias("created"))
        open_ = before.select(F.col("noplate_norm").alias("plate_norm"), F.col("tel_norm").alias("tel_digits"))
    hashed = files.select("path", "content", F.sha2("content", 256).alias("sha256"))
    records, skipped = ingest(hashed, known, extractor, as_of_year, preprocessor, open_, once=lambda df: store.once(df, "reads", batch))
    processed = spark.read.parquet(store.place("reads", batch)).select("sha256", "processed")
    store.write(records.join(processed, "sha256"), "records", batch)
    store.write(skipped, "skipped", batch)
    store.write(spark.range(1).select(F.current_timestamp().alias("at")), "commits", batch)


def run(stream: DataFrame, folder: str, extractor: Extractor, as_of_year: int, preprocessor: Preprocessor | None = None, step: Callable = ingest_batch) -> Store:
    """Ingest what the stream (path, content) has by now; state of the stream and the store are under `folder`."""
    store = Store(stream.sparkSession, f"{folder.rstrip('/')}/store")
    query = (
        stream.writeStream.foreachBatch(lambda df, n: step(store, df, n, extractor, as_of_year, preprocessor)).option("checkpointLocation", f"{folder.rstrip('/')}/stream").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return store
