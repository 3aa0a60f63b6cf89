"""A persisted n-gram index beside a folder of record files, so that a search reads only files that can hold a hit.

For each file the index holds which n-grams its columns have: the padded 3-grams of words, for similarity, and the 1- to 3-grams of
the whole lower-cased text, for substrings and edits.  Postings are written in buckets of the gram's hash, so a search reads
the buckets of its own grams; a second table names the files that are indexed, with the lengths of their texts.  A file counts as
indexed only when it stands there, which is written last; files that are not are always read.

A condition is a list of parts (kind, column, grams, need): a file can hold a hit if of each part's grams at least `need` occur
in it.  They follow from the search's own predicates:
- similarity of at least t: a text that shares s of |q| + |g| - s grams shares t * |q| of them at least;
- containment: all n-grams of what is looked for;
- at most k edits: each edit touches n n-grams at most, and changes the length by one at most.

Defined cases: null texts have no grams; an empty folder or no indexed file gives no rows; a text that gives no grams to look for
prunes nothing; files that were removed are passed over; added files are found before and after `update`.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial, reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import similarity
from recordloom.operators import search as fuzzy

LONGEST = 3
#: Kept files beyond which the folder is read whole: the search is not selective then.
MAX_PATHS = 20_000
#: Distinct grams that a task of `update` keeps before it gives them out.
KEPT = 2_000_000


@dataclass
class Part:
    kind: str
    column: str
    grams: set[str]
    need: int


@dataclass
class Condition:
    """parts that must all hold; lengths: (column, least, most) of a text in the file, if it matters."""

    parts: list[Part]
    lengths: tuple[str, int, int] | None = None


@dataclass
class Pruned:
    """Files to read, and how many there are."""

    paths: list[str]
    total: int
    conditions: list[Condition] = field(default_factory=list)


def plain_grams(s: str, n: int) -> set[str]:
    return {s[i : i + n] for i in range(len(s) - n + 1)}


def distinct_grams(texts: list[str], n: int) -> np.ndarray:
    """The distinct n-grams of the texts, each as one number: code points of 21 bits one behind the other."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(points) < n:
        return np.zeros(0, np.uint64)
    packed = points[: len(points) - n + 1].copy()
    for i in range(1, n):
        packed = packed << np.uint64(21) | points[i : len(points) - n + 1 + i]
    # A gram ends within the text that it begins in.
    inside = np.arange(len(packed)) + n <= np.repeat(np.cumsum(size), size)[: len(packed)]
    return np.unique(packed[inside])


def unpacked(grams: np.ndarray, n: int) -> list[str]:
    points = np.stack([grams >> np.uint64(21 * (n - 1 - i)) & np.uint64((1 << 21) - 1) for i in range(n)], 1)
    s = points.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [s[i : i + n] for i in range(0, len(s), n)]


def padded(words: str) -> list[str]:
    """Each of the words, which are a line each, with two blanks before and one behind."""
    return [f"  {w} " for w in words.split("\n")] if words else []


def file_grams(batches: Iterator[pa.RecordBatch], kinds: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """kind, column, gram, file of rows (file, a text for each of kinds), distinct in a task but for what is given out on the way at KEPT grams."""
    kept: dict[tuple[str, int, int], np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (file, i, n), grams in kept.items():
            for k in range(0, len(grams), 100_000):
                some = unpacked(grams[k : k + 100_000], n)
                yield pa.RecordBatch.from_pydict({"kind": [kinds[i][0]] * len(some), "column": [kinds[i][1]] * len(some), "gram": some, "file": [file] * len(some)})
        kept.clear()

    for b in batches:
        files = b.column(0).to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(np.append(True, files[1:] != files[:-1])) if len(files) else []
        for lo, hi in zip(begins, [*begins[1:], len(files)], strict=True):
            for i, (kind, _) in enumerate(kinds):
                texts = b.column(i + 1).slice(lo, hi - lo).to_pylist()
                if kind == "word":
                    texts = [w for t in texts for w in padded(t)]
                for n in [LONGEST] if kind == "word" else range(1, LONGEST + 1):
                    key = (files[lo], i, n)
                    new = distinct_grams(texts, n)
                    kept[key] = np.union1d(kept[key], new) if key in kept else new
        if sum(map(len, kept.values())) > KEPT:
            yield from out()
    yield from out()


def sure(grams: set[str]) -> set[str]:
    """Grams that stand in any text around them: how a capital sigma is lower-cased depends on its neighbours."""
    return {g for g in grams if not {"σ", "ς"} & set(g)}


def alike(column: str, grams: set[str], threshold: float) -> Condition | None:
    """grams: padded 3-grams of the words, as `trigrams` gives them."""
    need = max(1, math.ceil(threshold * len(grams) - 1e-9))
    return Condition([Part("word", column, sure(grams), need - len(grams) + len(sure(grams)))]) if grams else None


def holds(column: str, fragments: list[str]) -> Condition:
    """All of the fragments occur in the column."""
    parts = []
    for f in (f.lower() for f in fragments if f):
        grams = sure(plain_grams(f, min(LONGEST, len(f))))
        parts.append(Part("plain", column, grams, len(grams)))
    return Condition(parts)


def edited(column: str, q: str, most: int = 2) -> Condition | None:
    parts = []
    for n in range(1, LONGEST + 1):
        grams = plain_grams(q.lower(), n)
        parts.append(Part("plain", column, sure(grams), len(sure(grams)) - n * most))
    return Condition(parts, (column, max(1, len(q) - most), len(q) + most)) if q else None


def like_fragments(pattern: str) -> list[str]:
    """What a LIKE pattern asks for between its wildcards."""
    return [f for f in re.split(r"[%_]", pattern) if f]


class NgramIndex:
    """rows_folder: flat folder of Parquet files; index_folder: where the two tables are; words, plains: columns by kind of gram."""

    def __init__(self, spark: SparkSession, rows_folder: str, index_folder: str, words: list[str], plains: list[str], buckets: int = 64):
        self.spark, self.rows_folder, self.buckets = spark, rows_folder, buckets
        self.words, self.plains = words, plains
        self.postings_folder, self.files_folder = f"{index_folder.rstrip('/')}/postings", f"{index_folder.rstrip('/')}/files"

    def paths(self) -> dict[str, str]:
        """Path of each file by its name."""
        return {unquote(os.path.basename(p)): p for p in self.spark.read.parquet(self.rows_folder).inputFiles()}

    def _files(self) -> DataFrame | None:
        """The table of indexed files; none before the first update."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.files_folder)
        there = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.parquet(self.files_folder).dropDuplicates(["file"]) if there else None

    def indexed(self) -> set[str]:
        files = self._files()
        return set() if files is None else {r.file for r in files.select("file").collect()}

    def update(self) -> list[str]:
        """Index the files that are not yet; their names.  Grams are made distinct per file before they are shuffled."""
        have = self.indexed()
        new = {name: path for name, path in self.paths().items() if name not in have}
        if not new:
            return []
        rows = self.spark.read.parquet(*new.values()).withColumn("file", F.col("_metadata.file_name"))

        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
        # Lower case and words are the search's own; cutting into grams is all that the tasks' arrays do.
        texts = [F.array_join(similarity.words(text(c)), "\n") for c in self.words] + [F.lower(text(c)) for c in self.plains]
        kinds = [("word", c) for c in self.words] + [("plain", c) for c in self.plains]
        cells = rows.select("file", *[t.alias(f"t{i}") for i, t in enumerate(texts)])
        grams = cells.mapInArrow(partial(file_grams, kinds=kinds), "kind string, column string, gram string, file string").distinct()
        bucketed = grams.withColumn("bucket", F.pmod(F.hash("gram"), F.lit(self.buckets)))
        bucketed.repartition("bucket").sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").parquet(self.postings_folder)
        size = {c: F.length(text(c)) for c in self.plains}
        lengths = [f(F.when(n > 0, n)).alias(f"{k}_{c}") for c, n in size.items() for k, f in (("least", F.min), ("most", F.max))]
        rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), *lengths).write.mode("append").parquet(self.files_folder)
        return sorted(new)

    def prune(self, conditions: list[Condition | None]) -> Pruned:
        """Files in which at least one of the conditions can hold, and those not indexed."""
        paths, some = self.paths(), [c for c in conditions if c is not None]
        files = self._files()
        if not some or files is None:
            return Pruned(list(paths.values()) if some else [], len(paths), some)
        asked = [(i, k, p.kind, p.column, g) for i, c in enumerate(some) for k, p in enumerate(c.parts) if p.need > 0 for g in p.grams]
        needs = [(i, k, p.need) for i, c in enumerate(some) for k, p in enumerate(c.parts) if p.need > 0]
        q = self.spark.createDataFrame(asked, "c int, part int, kind string, column string, gram string").withColumn("bucket", F.pmod(F.hash("gram"), F.lit(self.buckets)))
        buckets = [r.bucket for r in q.select("bucket").distinct().collect()]
        postings = self.spark.read.parquet(self.postings_folder).filter(F.col("bucket").isin(buckets)).drop("bucket")
        have = postings.join(F.broadcast(q.drop("bucket")), ["kind", "column", "gram"]).groupBy("file", "c", "part").agg(F.count_distinct("gram").alias("n"))
        met = have.join(F.broadcast(self.spark.createDataFrame(needs, "c int, part int, need int")), ["c", "part"]).filter("n >= need").groupBy("file", "c").agg(F.count(F.lit(1)).alias("parts"))
        parts = {i: sum(p.need > 0 for p in c.parts) for i, c in enumerate(some)}
        in_range = {i: F.coalesce((F.col(f"most_{c.lengths[0]}") >= c.lengths[1]) & (F.col(f"least_{c.lengths[0]}") <= c.lengths[2]), F.lit(False)) if c.lengths else F.lit(True) for i, c in enumerate(some)}
        wide = files.join(met.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("c", "parts"))).alias("met")), "file", "left")
        holds_ = [(F.coalesce(F.try_element_at("met", F.lit(i)), F.lit(0)) >= n) & in_range[i] for i, n in parts.items()]
        left_out = wide.filter(~reduce(lambda a, b: a | b, holds_)).select("file")
        out = {r.file for r in left_out.collect()}
        return Pruned([p for name, p in paths.items() if name not in out], len(paths), some)

    def rows(self, pruned: Pruned) -> DataFrame:
        schema = self.spark.read.parquet(self.rows_folder).schema
        if not pruned.paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(pruned.paths if len(pruned.paths) <= MAX_PATHS else [self.rows_folder]))

    def search_conditions(self, texts: list[str], threshold: float = 0.3) -> list[Condition | None]:
        out: list[Condition | None] = []
        q_rows = fuzzy.asked(self.spark, texts).withColumns({f"g_{f}": similarity.trigrams(F.coalesce(f"q_{f}", F.lit(""))) for f in fuzzy.FIELDS})
        for q in q_rows.collect():
            out += [alike(f"{f}_norm", set(q[f"g_{f}"]), threshold) for f in fuzzy.FIELDS]
            if q.q_tel:
                out += [holds("tel_digits", [q.q_tel]), edited("tel_digits", q.q_tel)]
            if q.q_plate:
                out.append(edited("plate_norm", q.q_plate))
        return out

    def search(self, texts: list[str], top: int = 20, threshold: float = 0.3, include_pending: bool = False) -> DataFrame:
        """`search` over the files that can hold a candidate: the same rows."""
        pruned = self.prune(self.search_conditions(texts, threshold))
        return fuzzy.search(self.rows(pruned), texts, top, threshold, include_pending)

    def box(self, columns: dict[str, str]) -> Pruned:
        """Files that can hold a row in which one of the columns fits its text (as a LIKE pattern, wildcards live)."""
        return self.prune([holds(c, like_fragments(v)) for c, v in columns.items() if v])
