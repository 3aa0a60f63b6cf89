"""Token ids of all documents in ascending order of their ids, in wavelet files of a bounded number of tokens each.

1. A narrow pass (id, digest of the text, salt, size) is ordered by range; the first key of each range is all that comes to the
   driver, as many as there are ranges of about `part_bytes` of text.
2. Each text is encoded where it is read (`token_ids`), its end id appended, and its ids alone are shuffled to the range of
   its key, sorted there, and written as files of `shard_tokens` ids (`wavelet`), one row and one Parquet file each, beside
   the list of its documents.  A document may reach over several files, so memory is bounded by a file, not a document.
3. Files are read back on their own: places, lengths and checksums come from what is in them.  `documents` restores every
   document's ids or checksum, `count_token`, `occurrences` and `tokens_at` answer from the bit-planes.

The salt spreads many repeats of one row over several ranges; equal rows are interchangeable.

Defined cases: null text counts as empty (the end id alone); null ids come first, repeated ids are ordered by their texts;
very long texts are cut into files as any others; an empty table writes no files and gives no rows; other columns of the
input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from recordloom.llm.common import bound_batches
from recordloom.llm.token_ids import ids_of, tokenizer
from recordloom.llm.wavelet import Wavelet, build
from recordloom.session import cut

SHARD_TOKENS, PART_BYTES = 4_000_000, 8_000_000
DOCUMENT = "array<struct<id:{},nth:bigint,at:bigint,n:bigint,piece:int,last:boolean>>"


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, part_bytes: int = PART_BYTES) -> None:
    """Encode docs by the tokenizer file `path` (present on every executor) and write token files to the new folder `folder`."""
    spark = docs.sparkSession
    bound_batches(spark)
    width = 2 if max(end_id, tokenizer(path).get_vocab_size() - 1) < 1 << 16 else 4
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), F.monotonically_increasing_id().bitwiseAND(1023).alias("salt"), text.alias("text"))
    kind = keyed.schema["id"].dataType.simpleString()
    narrow = cut(keyed.select("id", "h", "salt", F.octet_length("text").alias("size")))
    parts = max(1, -(-(narrow.agg(F.sum(F.col("size").cast("bigint") + 1)).first()[0] or 0) // part_bytes))
    ranged = narrow.select("id", "h", "salt").repartitionByRange(parts, "id", "h", "salt")
    firsts = ranged.groupBy(F.spark_partition_id()).agg(F.min(F.struct(F.col("id").isNotNull().alias("some"), "id", "h", "salt")).alias("k")).select("k.*").collect()
    bounds = sorted((r.some, r.id, r.h, r.salt) if r.some else (False, r.h, r.salt) for r in firsts)[1:]
    dtype = np.dtype(f"<u{width}")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at = ids_of(path, b.column(3))
            many = np.diff(at) + 1
            ends = np.cumsum(many)
            flat = np.full(ends[-1] if len(ends) else 0, end_id, dtype)
            inside = np.ones(len(flat), bool)
            inside[ends - 1] = False
            flat[inside] = ids
            begin = np.append(0, ends) * width
            key = zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)
            part = [bisect_right(bounds, (True, i, h, s) if i is not None else (False, h, s)) for i, h, s in key]
            own = pa.Array.from_buffers(pa.large_binary(), len(many), [None, pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(flat)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(part, pa.int32()), own], ["id", "h", "salt", "part", "ids"])

    encoded = keyed.mapInArrow(encode, f"id {kind}, h bigint, salt bigint, part int, ids binary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = None
        for b in batches:
            for i, part, ids in zip(b.column(0), b.column(1).to_pylist(), b.column(2), strict=True):
                if files is None or part != files.part:
                    if files is not None:
                        yield from files.rest()
                    files = _Files(part, shard_tokens, dtype)
                yield from files.add(i.as_py(), np.frombuffer(ids.as_buffer(), dtype))
        if files is not None:
            yield from files.rest()

    of = to_arrow_type(spark.range(0).select(F.lit(None).cast(DOCUMENT.format(kind)).alias("x")).schema["x"].dataType)

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in pack(batches):
            yield pa.RecordBatch.from_arrays([pa.array([row[k]], t) for k, t in (("part", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("documents", of), ("content", pa.binary()))], ["part", "first", "n", "documents", "content"])

    dealt = encoded.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", F.col("id").asc_nulls_first(), "h", "salt").select("id", "part", "ids")
    dealt.mapInArrow(written, f"part int, first bigint, n bigint, documents {DOCUMENT.format(kind)}, content binary").write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(folder)


class _Files:
    """Files of one range, filled one document after the other."""

    def __init__(self, part: int, tokens: int, dtype: np.dtype):
        self.part, self.tokens, self.dtype = part, tokens, dtype
        self.first, self.nth, self.held, self.parts, self.documents = 0, 0, 0, [], []

    def add(self, ident, ids: np.ndarray) -> Iterator[dict]:
        done, piece = 0, 0
        while done < len(ids):
            take = min(len(ids) - done, self.tokens - self.held)
            self.documents.append({"id": ident, "nth": self.nth, "at": self.held, "n": take, "piece": piece, "last": done + take == len(ids)})
            self.parts.append(ids[done : done + take])
            self.held, done, piece = self.held + take, done + take, piece + 1
            if self.held == self.tokens:
                yield from self.rest()
        self.nth += 1

    def rest(self) -> Iterator[dict]:
        if self.held:
            yield {"part": self.part, "first": self.first, "n": self.held, "documents": self.documents, "content": build(np.concatenate(self.parts).astype(self.dtype))}
            self.first, self.held, self.parts, self.documents = self.first + self.held, 0, [], []


def _starts(files: DataFrame) -> Column:
    """Tokens before each range, by its number: as many figures as there are ranges."""
    rows = dict(files.groupBy("part").agg(F.sum("n")).collect())
    starts, n = [], 0
    for part in range(max(rows, default=-1) + 1):
        starts.append(n)
        n += rows.get(part, 0)
    return F.get(F.lit(starts) if starts else F.array(F.lit(0)), F.col("part")).cast("bigint")


def open_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder: part, first, n, documents, content, start (tokens of all files before it)."""
    files = spark.read.parquet(folder)
    return files.withColumn("start", _starts(files) + F.col("first"))


def _joined(crcs: list[tuple[int, int]]) -> int:
    """CRC-32 of byte strings one behind the other, from theirs and their lengths: a zero byte is a linear map of the state, applied by squaring."""
    total = 0
    for crc, size in crcs:
        step, k = [*(_zero_bit(1 << i) for i in range(32))], size * 8
        while k:
            if k & 1:
                total = _apply(step, total)
            step, k = [_apply(step, x) for x in step], k >> 1
        total ^= crc
    return total


def _zero_bit(x: int) -> int:
    return (x >> 1) ^ (0xEDB88320 if x & 1 else 0)


def _apply(step: list[int], x: int) -> int:
    out, i = 0, 0
    while x:
        if x & 1:
            out ^= step[i]
        x, i = x >> 1, i + 1
    return out


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids) of every document, from the files alone."""
    files = open_files(spark, folder)
    bound_batches(spark)
    kind = files.schema["documents"].dataType.elementType["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, start, docs, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                ids = Wavelet(content.as_buffer()).ids().astype("<u4")
                own = pa.RecordBatch.from_struct_array(docs.values)
                at, n = own.column("at").to_numpy(), own.column("n").to_numpy()
                crc = [zlib.crc32(ids[a : a + k]) for a, k in zip(at.tolist(), n.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([own.column("id"), pa.array(np.full(len(n), part, np.int32)), own.column("nth"), own.column("piece"), own.column("last"), pa.array(at + start), own.column("n"), pa.array(crc, pa.int64())], ["id", "part", "nth", "piece", "last", "start", "n", "crc"])

    pieces = files.select("part", "start", "documents", "content").mapInArrow(read, f"id {kind}, part int, nth bigint, piece int, last boolean, start bigint, n bigint, crc bigint")
    whole = pieces.filter("piece = 0 AND last").select(F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    joined = F.udf(lambda xs: _joined([(x.crc, 4 * x.n) for x in xs]), "bigint")
    cut_up = pieces.filter("NOT (piece = 0 AND last)").groupBy("part", "nth").agg(F.first("id").alias("doc_id"), F.min("start").alias("start"), F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("piece", "crc", "n"))).alias("p"))
    return whole.unionByName(cut_up.select("doc_id", "start", "n_tokens", joined("p").alias("ids_crc32")))


def count_token(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """start, n, hits of every file: by following one interval through the planes."""
    hits = F.udf(lambda content: Wavelet(content).count(token), "bigint")
    return open_files(spark, folder).select("start", "n", hits("content").alias("hits"))


def occurrences(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """doc_id, place (counted over all files) of every occurrence of an id."""
    files = open_files(spark, folder)
    bound_batches(spark)
    kind = files.schema["documents"].dataType.elementType["id"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, docs, content in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                places = Wavelet(content.as_buffer()).occurrences(token)
                own = pa.RecordBatch.from_struct_array(docs.values)
                of = np.searchsorted(own.column("at").to_numpy(), places, "right") - 1
                yield pa.RecordBatch.from_arrays([own.column("id").take(pa.array(of)), pa.array(places + start)], ["doc_id", "place"])

    return files.select("start", "documents", "content").mapInArrow(find, f"doc_id {kind}, place bigint")


def tokens_at(spark: SparkSession, folder: str, begin: int, end: int) -> DataFrame:
    """place, token of the global places begin to end - 1, from the files that hold them only."""

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                w = Wavelet(content.as_buffer())
                places = range(max(begin, start), min(end, start + len(w)))
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([w.access(p - start) for p in places], pa.int64())], ["place", "token"])

    held = open_files(spark, folder).filter((F.col("start") < end) & (F.col("start") + F.col("n") > begin))
    return held.select("start", "content").mapInArrow(get, "place bigint, token bigint")
