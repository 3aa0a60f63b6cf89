"""Exact deduplication as a log-structured merge index of digests (built-in functions only).

* memtable   - each input partition is one memtable; map-side aggregation folds its rows to one entry a (digest, id),
  and `flush` writes the entries of a batch as runs sorted by digest;
* compaction - `compact` merges the runs of a batch: per digest the identifier that is kept and the number of rows;
* filter     - of a level's digests, a bitmap of at most 16 MB written beside it (KeyFilter);
* levels     - with an `index_path` the index outlives the call.  The digests of a batch probe the filters of the level
  that stands, and only its rows that may be hit are read further and merged.  Then all are merged into the next level,
  and texts that are new to the index are added to it, for later comparisons;
* hits       - digests with over one row.  Their texts (found again through a bounded key filter, so texts that
  occur once are never shuffled) are grouped by the text itself: equality of bytes decides, the digest only brings
  rows together.  A digest with two texts gets one group per text.  Hits on earlier batches are compared with the
  text that the index holds.

Without an `index_path` there is one batch, and the index is a scratch table.

Defined cases: null text counts as empty; very long texts are read whole; repeated rows count each, and one of the rows with
the kept id stays; a null id stays only where its group has no other; an empty table gives no rows; other columns of the input
are ignored.  Should two batches have different texts of one SHA-256, the call ends with an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.common import KeyFilter, join_hot
from recordloom.session import cut, scratch_path

#: The extreme identifier that stays.
_KEEP = {"max": F.max, "min": F.min}


def _digest(text_col: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def memtables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batch: int = 0) -> DataFrame:
    """digest (binary), doc_id, run (of this batch and memtable), m: one entry for each digest, id and memtable."""
    run = (F.lit(batch).cast("bigint") * (1 << 32) + F.spark_partition_id()).alias("run")
    return docs.select(_digest(text_col).alias("digest"), F.col(id_col).alias("doc_id"), run).groupBy("digest", "doc_id", "run").agg(F.count(F.lit(1)).alias("m"))


def flush(entries: DataFrame, path: str) -> None:
    """Write entries as runs sorted by digest, with Parquet's statistics on it."""
    entries.sortWithinPartitions("digest", "doc_id", "run").write.parquet(path)


def _rank(keep: str):
    """An identifier and the run, for the extreme of it: null ids lose, and of equal ids the earliest run wins."""
    last = F.col("doc_id").isNull() if keep == "min" else F.col("doc_id").isNotNull()
    return F.struct(last.alias("known"), F.col("doc_id"), (F.col("run") if keep == "min" else -F.col("run")).alias("r"))


def compact(runs: DataFrame, keep: str = "min") -> DataFrame:
    """Merge runs: digest, keep (struct of id and run), n rows."""
    return runs.groupBy("digest").agg(_KEEP[keep](_rank(keep)).alias("keep"), F.sum("m").alias("n"))


def _merged(levels: DataFrame, keep: str) -> DataFrame:
    return levels.groupBy("digest").agg(_KEEP[keep]("keep").alias("keep"), F.sum("n").alias("n"))


def verified_groups(docs: DataFrame, level: DataFrame, text_col: str) -> DataFrame:
    """For digests that occur more than once, a row for each of their texts after comparing bytes: digest, n."""
    hits = level.filter("n > 1").select(F.xxhash64("digest").alias("k"))
    seen = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    near = KeyFilter(hits, "k", hits.count()).maybe(seen.withColumn("k", F.xxhash64("digest")), "k")
    # Bytes decide: the grouping key is the text itself.
    by_text = near.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"))
    return cut(by_text.filter("n > 1").select("digest", "n"))


class Index:
    """Levels of an index in a shared folder: level-N (digest, keep, n), filter-N (its bitmap) and texts-N (texts new in batch N)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        folder = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
        # A level counts once its last part, the filter, is whole; what an ended call left is passed over by its number.
        done = [int(n.split("-")[1]) for n in names if n.startswith("filter-") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        self.top = max(done, default=None)
        self.next = 1 + max((int(n.split("-")[1]) for n in names if "-" in n), default=-1)
        self.texts = [f"{self.path}/texts-{n}" for n in done]

    def level(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/level-{self.top}")

    def hit(self, digests: DataFrame) -> DataFrame:
        """The rows of digests (a column digest) that the level's filter lets pass: all that are in it, and few others."""
        saved = self.spark.read.parquet(f"{self.path}/filter-{self.top}")
        return KeyFilter.of_pages(saved).maybe(digests.withColumn("k", F.xxhash64("digest")), "k").drop("k")

    def add(self, groups: DataFrame, docs: DataFrame, text_col: str, keep: str) -> None:
        """Write the next level of this one and a batch's groups, the texts that are new, and the filter."""
        own = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256))).select("digest", "text")
        if self.top is not None:
            old = self.level()
            own = own.join(self.hit(groups.select("digest")).join(old.select("digest"), "digest", "left_semi"), "digest", "left_anti")
            groups = _merged(old.unionByName(groups), keep)
        own.dropDuplicates(["digest"]).write.parquet(f"{self.path}/texts-{self.next}")
        groups.sortWithinPartitions("digest").write.parquet(f"{self.path}/level-{self.next}")
        level = self.spark.read.parquet(f"{self.path}/level-{self.next}").select(F.xxhash64("digest").alias("k"))
        KeyFilter(level, "k", level.count()).saved().write.parquet(f"{self.path}/filter-{self.next}")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", index_path: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "min" or "max" identifier stays.  index_path: a shared folder whose index holds earlier batches; their rows count in
    keep_id and group_size, and this batch is added.  The caller adds one batch at a time.
    """
    spark: SparkSession = docs.sparkSession
    index = Index(spark, index_path) if index_path else None
    path = scratch_path(spark, "lsm")
    flush(memtables(docs, id_col, text_col, index.next if index else 0), path)
    runs = spark.read.parquet(path)
    groups = cut(compact(runs, keep))
    verified = verified_groups(docs, groups, text_col)
    out = _resolve(docs, runs, groups, verified, keep, id_col, text_col, index)
    if index:
        out = cut(out)
        index.add(groups, docs, text_col, keep)
    return out


def _with_earlier(index: Index, groups: DataFrame, docs: DataFrame, text_col: str, keep: str) -> DataFrame:
    """groups with the rows of earlier batches, after comparing their texts."""
    hit = cut(index.hit(groups.select("digest")).join(index.level(), "digest"))
    keys = KeyFilter(hit.select(F.xxhash64("digest").alias("k")), "k", hit.count())
    held = keys.maybe(index.spark.read.parquet(*index.texts).withColumn("k", F.xxhash64("digest")), "k").select("digest", F.col("text").alias("held"))
    own = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    own = keys.maybe(own.withColumn("k", F.xxhash64("digest")), "k").select("digest", "text").distinct()
    if not held.join(hit.select("digest"), "digest", "left_semi").join(own, "digest").filter("held <> text").isEmpty():
        raise ValueError("two texts of one SHA-256 in different batches")
    met = hit.select("digest", F.col("keep").alias("old"), F.col("n").alias("before"))
    first = (F.least if keep == "min" else F.greatest)("keep", "old")
    return cut(groups.join(met, "digest", "left").select("digest", first.alias("keep"), (F.col("n") + F.coalesce("before", F.lit(0))).alias("n")))


def _resolve(docs: DataFrame, runs: DataFrame, groups: DataFrame, verified: DataFrame, keep: str, id_col: str, text_col: str, index: Index | None) -> DataFrame:
    # A digest is sound when byte comparison found all its rows in one group.
    good = verified.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("vn"))
    checked = groups.join(good, "digest", "left").withColumn("sound", (F.col("n") == 1) | ((F.col("texts") == 1) & (F.col("vn") == F.col("n"))))
    clash = checked.filter(~F.coalesce("sound", F.lit(False))).select("digest", "n")
    if not clash.isEmpty():
        if index:
            raise ValueError("two texts of one SHA-256 in a batch of a lasting index")
        entries = _split_clashes(docs, runs, groups, clash, keep, id_col, text_col)
    else:
        every = _with_earlier(index, groups, docs, text_col, keep) if index and index.top is not None else groups
        entries = join_hot(runs, every, "digest", "n", runs.count())
    first = F.col("keep")["doc_id"].eqNullSafe(F.col("doc_id")) & (F.abs(F.col("keep")["r"]) == F.col("run"))
    return (
        entries.withColumn("i", F.explode(F.expr("sequence(1L, m)")))
        .select(
            "doc_id",
            F.col("keep")["doc_id"].alias("keep_id"),
            F.col("n").alias("group_size"),
            (first & (F.col("i") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )


def _split_clashes(docs: DataFrame, runs: DataFrame, groups: DataFrame, clash: DataFrame, keep: str, id_col: str, text_col: str) -> DataFrame:
    """Entries with their group, where some digests stand for several texts: those are grouped by text."""
    bad = F.broadcast(clash.select("digest")) if clash.count() <= 100_000 else clash.select("digest")
    run = F.spark_partition_id().cast("bigint")
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(id_col).alias("doc_id"), run.alias("run"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256))).join(bad, "digest", "left_semi")
    per = rows.groupBy("digest", "text", "doc_id", "run").agg(F.count(F.lit(1)).alias("m"))
    of = per.groupBy("digest", "text").agg(_KEEP[keep](_rank(keep)).alias("keep"), F.sum("m").alias("n"))
    split = per.join(of, ["digest", "text"]).drop("text")
    rest = runs.join(clash.select("digest"), "digest", "left_anti").join(groups, "digest")
    return rest.unionByName(split.select(*rest.columns))
