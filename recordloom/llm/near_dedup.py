"""Near-duplicate detection: improved consistent weighted sampling over TF-IDF shingles.

1. Equal texts are one class by their SHA-256.  Each class has its text written once, and all passes read that table.
2. Shingles are five consecutive words (fewer words: one shingle of all).  Weight = (1 + ln tf) * idf, with idf = 1
   for shingles in at most RARE_SHARE of the classes and falling to IDF_FLOOR towards those in all of them.  Document
   frequencies come from a pass over all classes that folds hashed counters (two rows of 2**20, about twelve times as
   many as there can be frequent shingles); only counters over the threshold, a bounded number, reach the workers.
   With `sources`, near copies count once for what they share, so a group of any size does not lessen its own links:
   all classes that have a frequent shingle are linked as in step 4, at similarity SOURCE and without idf; a component of
   these links is one source, and the frequency of a shingle is the number of sources that have it.  The members of a
   component in one part of the table are folded before they are shuffled, so that a component of any size sends each
   shingle once from there.  Every class is still compared with full weights.
3. A signature has BANDS * ROWS consistent weighted samples (Ioffe's improved scheme; the random variables of an
   element come from fixed tables that its hash indexes, and are compared by rank).  A sample of two texts is equal with
   the probability of their weighted Jaccard similarity; at 0.8 the chance that no band agrees is (1 - 0.8**4)**18 = 8e-5.
4. In a bucket (band and key) all members are compared with one of them: fewer pairs than members, however
   large the bucket.  Pairs whose samples agree are verified by their exact weighted Jaccard similarity, from
   whole texts, and verified links give components.
5. A bucket whose members lie in one component is done: no link in it can change a component.  In the others,
   members of different components are still to be compared, all with all: first by their samples (a byte of each), in
   blocks of a few hundred members dealt over tasks, which leaves only members with a partner whose samples agree;
   those exactly, in blocks in memory that give only links that join components.  A larger bucket than one block is
   dealt by a hash into parts, and every two parts are a block, so that no pair is left out; such a bucket costs the
   square of its members.

Results are one row per document with its class and component, and which document of a component stays.

Defined cases: null text counts as empty; all empty texts are one class, as are all equal ones; texts without
any word have no shingles and are near nothing but equal texts; very long texts are read whole, in a slice of their own;
repeated ids are reported per row, each in the class of its own text; null ids take part like any others and come last
where a smallest id is wanted; of repeated rows one stays; an empty table gives no rows; other columns of the input
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import KeyFilter, bound_batches, join_hot
from recordloom.llm.shingling import Shingled, mix, release, shingle, slices
from recordloom.operators.graph import connected_components
from recordloom.session import cut, parts_of, scratch_path

THRESHOLD = 0.8
BANDS, ROWS = 18, 4
RARE_SHARE, RARE_DOCS, IDF_FLOOR = 0.05, 20, 0.1
SKETCH_LOG2, SKETCH_ROWS = 20, 2
#: Similarity from which texts repeat one source, and equal samples (of 72) from which that is looked at.
SOURCE, SOURCE_AGREE = 0.5, 20
#: Frequent shingles of members that are folded at once.
FOLDED = 1 << 20
#: Members and shingles of a block that is compared exactly in memory (16 bytes a shingle, and about as many for the text).
MAX_OPEN, MAX_OPEN_SHINGLES = 4096, 3_000_000
#: Members of a block that is compared by samples: few while they are dealt in FEW_PARTS parts at most, then up to MAX_BLOCK.
BLOCK, MAX_BLOCK, FEW_PARTS = 256, 4096, 32
MIN_AGREE = 42
TABLE_LOG2 = 16
#: Shingles of texts that are sampled together; they stay in a core's cache.
SAMPLED = 16_384
_U = np.uint64


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of one text and their numbers of occurrences."""
    x = shingle(pa.array([text], pa.string()))
    return x.hashes, x.times


def _slots(s: np.ndarray) -> list[np.ndarray]:
    return [(mix(s + _U(r + 1)) >> _U(64 - SKETCH_LOG2)).astype(np.int64) for r in range(SKETCH_ROWS)]


@dataclass
class Idf:
    """Inverse document frequencies from the counters over the threshold."""

    n_docs: int
    slots: list[np.ndarray]
    counts: list[np.ndarray]

    @property
    def rare(self) -> float:
        return max(RARE_SHARE * self.n_docs, RARE_DOCS)

    def weights(self, s: np.ndarray, tf: np.ndarray) -> np.ndarray:
        w = 1.0 + np.log(tf)
        if not len(s) or any(not len(x) for x in self.slots):
            return w
        df = np.full(len(s), np.inf)
        for own, slots, counts in zip(_slots(s), self.slots, self.counts, strict=True):
            at = np.minimum(np.searchsorted(slots, own), len(slots) - 1)
            df = np.minimum(df, np.where(slots[at] == own, counts[at], 0))
        often = df > self.rare
        if often.any():
            w[often] *= np.clip(np.log(self.n_docs / df[often]) / np.log(self.n_docs / self.rare), IDF_FLOOR, 1.0)
        return w


PAGE = 1 << 10
#: Shingles from which the counters that one text hits twice matter.
LONG = 1 << 14


def document_frequencies(classes: DataFrame, n_docs: int, text_col: str = "text") -> Idf:
    """Counters over all texts: each partition folds its own, pages of them are added in order of the page."""
    idf = Idf(n_docs, [np.zeros(0, np.int64)] * SKETCH_ROWS, [np.zeros(0)] * SKETCH_ROWS)
    rare = idf.rare

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, n = np.zeros((SKETCH_ROWS, 1 << SKETCH_LOG2), np.int32), 0
        for b in batches:
            for _, part in slices(b.column(0)):
                x = shingle(part)
                n += len(x)
                long = np.flatnonzero(np.diff(x.at) > LONG)
                for r, own in enumerate(_slots(x.hashes)):
                    for i in long:
                        once = np.unique(own[x.one(i)])
                        c[r][once] += 1
                    np.add.at(c[r], np.delete(own, np.r_[tuple(x.one(i) for i in long)]) if len(long) else own, 1)
        if n:
            pages = c.reshape(-1, PAGE)
            for i in range(0, len(pages), 256):
                some = [(j, np.flatnonzero(pages[j])) for j in range(i, i + 256)]
                some = [(j, at) for j, at in some if len(at)]
                if some:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([j for j, _ in some], pa.int32()), pa.array([at.astype(np.int16).tobytes() for _, at in some], pa.binary()), pa.array([pages[j][at].tobytes() for j, at in some], pa.binary())],
                        ["page", "slots", "counts"],
                    )
        release()

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sums of the pages, which come in order: one page is in memory at a time."""
        page, total = None, np.zeros(PAGE, np.int64)

        def out() -> pd.DataFrame:
            at = np.flatnonzero(total > rare)
            return pd.DataFrame({"page": np.full(len(at), page, np.int32), "slot": at, "n": total[at]})

        for b in batches:
            for i, slots, counts in zip(b.page, b.slots, b.counts, strict=True):
                if i != page:
                    if page is not None:
                        yield out()
                    page, total = i, np.zeros(PAGE, np.int64)
                total[np.frombuffer(slots, np.int16)] += np.frombuffer(counts, np.int32)
        if page is not None:
            yield out()

    parts = classes.select(F.col(text_col).alias("t")).mapInArrow(fold, "page int, slots binary, counts binary")
    # A document has few shingles against 2**20 counters, so only a small, bounded share of them is frequent.
    some = parts.repartition("page").sortWithinPartitions("page").mapInPandas(add, "page int, slot bigint, n bigint").toPandas()
    flat = some.page.to_numpy(np.int64) * PAGE + some.slot.to_numpy(np.int64)
    for r in range(SKETCH_ROWS):
        own = flat >> SKETCH_LOG2 == r
        order = np.argsort(flat[own])
        idf.slots[r] = (flat[own] & ((1 << SKETCH_LOG2) - 1))[order]
        idf.counts[r] = some.n.to_numpy(np.float64)[own][order]
    return idf


def _held(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Components and codes, one pair for each code, of rows (component, held)."""
    size = pc.list_value_length(b.column("held")).to_numpy(zero_copy_only=False)
    return np.repeat(b.column("component").to_numpy(zero_copy_only=False), size), b.column("held").flatten().to_numpy()


def _pairs_once(components: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The components in order; and the pairs, each once and in order, as places among them and codes."""
    names, at = np.unique(components, return_inverse=True)
    pairs = np.unique(at.astype(np.int64) << 32 | codes)
    return names, pairs >> 32, (pairs & 0xFFFFFFFF).astype(np.int32)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (component, held) with those of one component as one that has each code once; FOLDED codes are kept at a time."""
    parts, n = [], 0

    def out(names: np.ndarray, at: np.ndarray, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(names), 1_000):
            lo, hi = np.searchsorted(at, [i, i + 1_000])
            begins = np.searchsorted(at[lo:hi], np.arange(i, min(i + 1_000, len(names)) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 1_000]), pa.ListArray.from_arrays(pa.array(begins), pa.array(codes[lo:hi]))], ["component", "held"])

    for b in batches:
        parts.append(_held(b))
        n += len(parts[-1][1])
        if n > FOLDED:
            names, at, codes = _pairs_once(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            parts, n = [(names[at], codes)], len(codes)
            if n > FOLDED // 2:
                yield from out(names, at, codes)
                parts, n = [], 0
    if n:
        yield from out(*_pairs_once(*(np.concatenate(x) for x in zip(*parts, strict=True))))


def source_counts(of: DataFrame, size: int) -> DataFrame:
    """code, n: how many components have each code from 0 to size - 1, from rows (component, held: distinct codes); rows without a component count as one each."""

    def sums(n: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["code", "n"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(size, np.int64)
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy(), minlength=size)
        yield sums(n)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Components come in order, so only the last one of a batch may go on."""
        n, last, open_ = np.zeros(size, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        for b in batches:
            components, codes = _held(b)
            names, at, codes = _pairs_once(np.concatenate([last, components]), np.concatenate([open_, codes]))
            done = at < len(names) - 1
            n += np.bincount(codes[done], minlength=size)
            open_ = codes[~done]
            last = np.repeat(names[-1:], len(open_))
        n[open_] += 1
        yield sums(n)

    alone = of.filter("component IS NULL").select("held").mapInArrow(each, "code int, n bigint")
    folded = of.filter("component IS NOT NULL").select("component", "held").mapInArrow(_folded, "component bigint, held array<int>")
    shared = folded.repartition("component").sortWithinPartitions("component").mapInArrow(once, "code int, n bigint")
    return alone.unionByName(shared).groupBy("code").agg(F.sum("n").alias("n"))


def once_per_source(classes: DataFrame, idf: Idf, key_col: str = "digest", text_col: str = "text") -> Idf:
    """idf with near copies counted once for what they share, over all classes that have a frequent counter."""
    if not any(len(x) for x in idf.slots):
        return idf
    spark, texts = classes.sparkSession, classes.select(F.col(key_col).alias("digest"), F.col(text_col).alias("text"))
    plain = Idf(idf.n_docs, [np.zeros(0, np.int64)] * SKETCH_ROWS, [np.zeros(0)] * SKETCH_ROWS)
    # A frequent counter's code is its place among those of all rows.
    begin = np.cumsum([0, *map(len, idf.slots)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, part in slices(b.column(1)):
                x = shingle(part)
                # The counters that each text has, each once: a row's number and the counter's code.
                of, codes = [], []
                text = np.repeat(np.arange(len(x)), np.diff(x.at))
                for r, (own, slots) in enumerate(zip(_slots(x.hashes), idf.slots, strict=True)):
                    if len(slots):
                        at = np.minimum(np.searchsorted(slots, own), len(slots) - 1)
                        hit = slots[at] == own
                        of.append(text[hit])
                        codes.append(at[hit] + begin[r])
                pairs = np.unique(np.concatenate(of) << 32 | np.concatenate(codes))
                has, begins = np.unique(pairs >> 32, return_index=True)
                if len(has):
                    some = shingle(part.take(pa.array(has)))
                    held = pa.ListArray.from_arrays(pa.array(np.append(begins, len(pairs)).astype(np.int32)), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(part)).take(pa.array(has)), *_signed(some, plain, some.at), pa.array(np.diff(some.at)), held], ["digest", "keys", "bits", "size", "held"])
        release()

    digest = texts.schema["digest"].dataType.simpleString()
    sigs = cut(texts.mapInArrow(run, f"digest {digest}, keys array<bigint>, bits binary, size bigint, held array<int>").withColumn("no", F.monotonically_increasing_id()))
    n = sigs.count()
    few = parts_of(spark, n)
    found = _star_links(_buckets(sigs, n), sigs, texts, plain, SOURCE, SOURCE_AGREE)
    source = connected_components(found, "a", "b", few).withColumnRenamed("id", "no")
    of = sigs.select("no", "held").join(source, "no", "left").select("component", "held")
    # As many rows as there are frequent counters, which is bounded.
    some = source_counts(of, int(begin[-1])).toPandas()
    n = np.zeros(begin[-1])
    n[some.code.to_numpy()] = some.n.to_numpy()
    counts = np.split(n, begin[1:-1])
    return Idf(idf.n_docs, idf.slots, counts)


class Sampler:
    """Consistent weighted samples: per element and sample gamma(2,1) r and c and uniform b, drawn from fixed tables.

    The tables are in order of what an element of weight 1 draws, and the high bits of its mixed hash are its place in
    them: the smallest hash is the smallest draw.  An element of another weight gets the place of its own draw.
    """

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 11):
        g = np.random.Generator(np.random.PCG64(seed))
        size = 1 << TABLE_LOG2
        self.samples = samples
        r, ln_c, b = g.gamma(2.0, 1.0, size), np.log(g.gamma(2.0, 1.0, size)), g.random(size)
        # ln a = ln c - r (t - b + 1) with t = floor(ln w / r + b); where w = 1, t = 0.
        unit = ln_c - r * (1 - b)
        order = np.argsort(unit)
        self.r, self.ln_c, self.b, self.unit = r[order], ln_c[order], b[order], unit[order]
        self.steps = mix(np.arange(1, samples + 1, dtype=_U))

    def _weighted(self, x: np.ndarray, ln_w: np.ndarray) -> np.ndarray:
        """Draws of elements whose weight is not 1, on the scale of mixed hashes; equal ones are equal (element, t)."""
        at = (x >> _U(64 - TABLE_LOG2)).astype(np.int64)
        r, b = self.r[at], self.b[at]
        t = np.floor(ln_w / r + b)
        place = np.minimum(np.searchsorted(self.unit, self.ln_c[at] - r * (t - b + 1)), (1 << TABLE_LOG2) - 1).astype(_U)
        low = (x ^ (t.astype(np.int64).astype(_U) * _U(0xD6E8FEB86659FD93))) & _U((1 << (64 - TABLE_LOG2)) - 1)
        return np.where(t == 0, x, place << _U(64 - TABLE_LOG2) | low)

    def of_all(self, s: np.ndarray, w: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A column of samples for each text; at: where the texts' elements begin (none is empty), with the end."""
        out = np.empty((self.samples, len(at) - 1), _U)
        odd = np.flatnonzero(w != 1.0)
        ln_w = np.log(w[odd])
        i = 0
        while i < len(at) - 1:
            j = max(i + 1, int(np.searchsorted(at, at[i] + SAMPLED, "right")) - 1)
            own, begins = s[at[i] : at[j]], at[i:j] - at[i]
            x = np.empty_like(own)
            lo, hi = np.searchsorted(odd, [at[i], at[j]])
            some, ln = odd[lo:hi] - at[i], ln_w[lo:hi]
            for k in range(self.samples):
                np.bitwise_xor(own, self.steps[k], out=x)
                x *= _U(0x9E3779B97F4A7C15)
                if len(some):
                    x[some] = self._weighted(x[some], ln)
                out[k, i:j] = np.minimum.reduceat(x, begins)
            i = j
        return out

    def signature(self, s: np.ndarray, w: np.ndarray) -> np.ndarray:
        return self.of_all(s, w, np.array([0, len(s)]))[:, 0]


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One key per band (rows) and text (columns), different between bands."""
    sig = sig.reshape(-1, rows, sig.shape[1])
    h = np.repeat(np.arange(1, len(sig) + 1, dtype=_U)[:, None], sig.shape[2], 1)
    for j in range(rows):
        h = mix(h * _U(31) + sig[:, j])
    return h.view(np.int64)


_SAMPLER: list[Sampler] = []


def _sampler() -> Sampler:
    if not _SAMPLER:
        _SAMPLER.append(Sampler())
    return _SAMPLER[0]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    total = a[1].sum() + b[1].sum()
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = a[0][at] == b[0]
    low = np.minimum(a[1][at[both]], b[1][both]).sum()
    return float(low / (total - low)) if total else 0.0


def _binary_rows(rows: np.ndarray) -> pa.Array:
    """A binary value of each row of bytes."""
    n, size = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * size, size, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def text_classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, digest, row: a number of its own); classes of equal texts (digest, first: struct of missing, doc_id and row, n); and the written table (digest, text) of distinct texts.

    Only texts that may repeat are shuffled.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = cut(base.select("doc_id", "digest", F.monotonically_increasing_id().alias("row")))
    own = cut(rows.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("n")), parts_of(docs.sparkSession, rows.count()))
    repeats = own.filter("n > 1").select(F.xxhash64("digest").alias("k"))
    split = KeyFilter(repeats, "k", repeats.count()).mark(base.withColumn("k", F.xxhash64("digest")), "k", "maybe")
    once = split.filter("NOT maybe").select("digest", "text")
    rest = split.filter("maybe").groupBy("digest").agg(F.min("text").alias("text"))
    path = scratch_path(docs.sparkSession, "classes")
    once.unionByName(rest.select("digest", "text")).write.parquet(path)
    return rows, own, docs.sparkSession.read.schema("digest binary, text string").parquet(path)


def _signed(x: Shingled, idf: Idf, at: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Keys and bits of the texts that begin at `at` (none is empty)."""
    sig = _sampler().of_all(x.hashes, idf.weights(x.hashes, x.times), at)
    keys = np.ascontiguousarray(band_keys(sig).T)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
    return lists, _binary_rows((mix(sig) >> _U(56)).astype(np.uint8).T)


def signatures(classes: DataFrame, idf: Idf) -> DataFrame:
    """digest, keys (one of each band), bits (a byte of each sample) and size (shingles); texts without shingles have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, part in slices(b.column(1)):
                x = shingle(part)
                size = np.diff(x.at)
                has = np.flatnonzero(size)
                if len(has):
                    lists, bits = _signed(x, idf, np.append(x.at[:-1][has], x.at[-1]))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(part)).take(pa.array(has)), lists, bits, pa.array(size[has])], ["digest", "keys", "bits", "size"])
        release()

    return classes.select("digest", "text").mapInArrow(run, "digest binary, keys array<bigint>, bits binary, size bigint")


def _texts_of(numbers: DataFrame, sigs: DataFrame, classes: DataFrame, parts: int) -> DataFrame:
    """no, text of the classes that `numbers` (no, distinct) names."""
    need = cut(numbers.join(sigs.select("no", "digest"), "no"), parts)
    keys = KeyFilter(need.select(F.xxhash64("digest").alias("k")), "k", need.count())
    return keys.maybe(classes.withColumn("k", F.xxhash64("digest")), "k").select("digest", "text").join(need, "digest").select("no", "text")


def _close_enough(pairs: DataFrame, sigs: DataFrame, least: int = MIN_AGREE) -> DataFrame:
    """Pairs whose samples agree often enough to be worth an exact comparison: at similarity 0.8, 58 of 72 do on average, and MIN_AGREE is over 4.5 standard deviations below that."""

    @F.pandas_udf("int")
    def agree(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int32")
        u, v = (np.frombuffer(b"".join(z), np.uint8).reshape(len(z), -1) for z in (x, y))
        return pd.Series((u == v).sum(1).astype(np.int32))

    a, b = (sigs.select(F.col("no").alias(c), F.col("bits").alias(f"bits_{c}")) for c in "ab")
    both = pairs.join(a, "a").join(b, "b")
    return both.withColumn("same", agree("bits_a", "bits_b")).filter(F.col("same") >= least).select("a", "b")


def verified(pairs: DataFrame, sigs: DataFrame, classes: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """a, b, similarity of the pairs that reach the threshold, from whole texts."""
    texts = _texts_of(pairs.select(F.explode(F.array("a", "b")).alias("no")).distinct(), sigs, classes, parts_of(sigs.sparkSession, sigs.count()))
    joined = pairs.join(texts.select(F.col("no").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("no").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            a, b = (p.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for i, part in slices(p.column(3)):
                own = a[i : i + len(part)]
                # The left text of consecutive pairs is read once.
                begins = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                x, y = shingle(p.column(2).slice(i, len(part)).take(pa.array(begins))), shingle(part)
                wx, wy = idf.weights(x.hashes, x.times), idf.weights(y.hashes, y.times)
                of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(own))))
                sim = np.array([weighted_jaccard((x.hashes[x.one(k)], wx[x.one(k)]), (y.hashes[y.one(j)], wy[y.one(j)])) for j, k in enumerate(of)])
                keep = np.flatnonzero(sim >= threshold - 1e-12)
                yield pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array(b[i + keep]), pa.array(sim[keep])], ["a", "b", "similarity"])
        release()

    return joined.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint, similarity double")


def block_links(comps: np.ndarray, sets: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> list[tuple[int, int]]:
    """Positions of links that join the components of a block, by exact similarities of all its members.

    Postings of the shingles that members share give the overlap of one member with all others at once.
    """
    sizes = [len(x) for x, _ in sets]
    total = np.array([w.sum() for _, w in sets])
    code = np.unique(np.concatenate([x for x, _ in sets]), return_inverse=True)[1]
    row, weight = np.repeat(np.arange(len(sets)), sizes), np.concatenate([w for _, w in sets])
    order = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange(code.max() + 2)) if len(code) else np.zeros(1, np.int64)
    label = {c: c for c in comps.tolist()}

    def root(c):
        while label[c] != c:
            label[c] = label[label[c]]
            c = label[c]
        return c

    # Every pair of different components has a member outside of the largest one, so only those look for partners.
    names, members = np.unique(comps, return_counts=True)
    largest = names[members.argmax()]
    begins = np.concatenate(([0], np.cumsum(sizes)))
    out = []
    for i in np.flatnonzero(comps != largest):
        own, w = code[begins[i] : begins[i + 1]], weight[begins[i] : begins[i + 1]]
        many = starts[own + 1] - starts[own]
        own, w, many = own[many > 1], w[many > 1], many[many > 1]
        if not len(own):
            continue
        at = order[np.repeat(starts[own] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())]
        low = np.bincount(row[at], np.minimum(weight[at], np.repeat(w, many)), minlength=len(sets))
        for j in np.flatnonzero(low >= (threshold - 1e-12) * (total[i] + total - low)):
            if (x := root(comps[i].item())) != (y := root(comps[j].item())):
                label[max(x, y)] = min(x, y)
                out.append((int(i), int(j)))
    return out


def agreeing(bits: np.ndarray, comps: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Members (a row of bits each) with a partner of another component and, if there are two parts, of the other part, whose samples agree."""
    found = np.zeros(len(bits), bool)
    left, right = (np.flatnonzero(part == p) for p in (part.min(), part.max()))
    there = np.ascontiguousarray(bits[right].T)
    for i in range(0, len(left), 64):
        own = left[i : i + 64]
        same = np.zeros((len(own), len(right)), np.uint8)
        for k, row in enumerate(there):
            same += bits[own, k][:, None] == row[None, :]
        hit = (same >= MIN_AGREE) & (comps[own][:, None] != comps[right][None, :])
        found[own] |= hit.any(1)
        found[right] |= hit.any(0)
    return found


def _by_parts(members: DataFrame, parts, own_block: bool) -> DataFrame:
    """members with part, x and y: a row for each block (x, y) of two parts that a member is in, and of a part alone if there is but one or `own_block` asks for it."""
    m = members.withColumn("parts", parts.cast("int")).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "no"), "parts").cast("int"))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    others = every if own_block else F.when(F.col("parts") == 1, every).otherwise(F.array_remove(every, F.col("part")))
    m = m.withColumn("other", F.explode(others))
    return m.withColumns({"x": F.least("part", "other"), "y": F.greatest("part", "other")}).drop("parts", "other")


def _open_links(members: DataFrame, sigs: DataFrame, classes: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """a, b: links between the components of each bucket of `members` (key, no, size, component), fewer for each block than it has members."""
    # Bands often give the same members; one bucket of each such set is enough.
    sets = members.groupBy("key").agg(F.sum(F.xxhash64("no").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    one = sets.groupBy("s", "n").agg(F.min("key").alias("key")).select("key", "n")
    few = F.least(F.ceil(F.col("n") / BLOCK), F.lit(FEW_PARTS))
    parts = F.when(F.col("n") <= 2 * BLOCK, 1).otherwise(F.greatest(few, F.ceil(F.col("n") / MAX_BLOCK)))
    rows = _by_parts(members.join(one, "key").join(sigs.select("no", "bits"), "no"), parts, True)

    def narrow(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.frombuffer(b"".join(pdf.bits), np.uint8).reshape(len(pdf), -1)
        return pdf.loc[agreeing(bits, pdf.component.to_numpy(), pdf.part.to_numpy()), ["key", "no", "size", "component"]]

    rows = rows.select("key", "x", "y", "part", "no", "size", "component", "bits")
    # Rows are few and narrow, but each block takes time: no coalescing of partitions by their bytes.
    tasks = int(sigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = rows.repartition(tasks, "key", "x", "y").groupBy("key", "x", "y").applyInPandas(narrow, "key bigint, no bigint, size bigint, component bigint")
    parts = parts_of(sigs.sparkSession, sigs.count())
    left = cut(left.distinct(), parts)
    total = left.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all"))
    tables = parts
    # Parts of half a block on average, with room for uneven ones; a member goes to the block of its part with each other one.
    over = F.greatest(F.col("n") / MAX_OPEN, F.col("all") / MAX_OPEN_SHINGLES)
    parts = F.when(over <= 1, 1).otherwise(F.greatest(F.ceil(over * 2.5), F.lit(2)))
    rows = _by_parts(left.join(total, "key"), parts, False).select("key", "x", "y", "no", "component")
    texts = _texts_of(left.select("no").distinct(), sigs, classes, tables)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sets = []
        for _, part in slices(pa.array(pdf.text, pa.large_string())):
            x = shingle(part)
            w = idf.weights(x.hashes, x.times)
            sets += [(x.hashes[x.one(i)], w[x.one(i)]) for i in range(len(x))]
        no = pdf.no.to_numpy()
        got = block_links(pdf.component.to_numpy(), sets, threshold)
        x, y = no[[i for i, _ in got]], no[[j for _, j in got]]
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)})

    return rows.join(texts, "no").groupBy("key", "x", "y").applyInPandas(run, "a bigint, b bigint").distinct()


def _merge(labels: DataFrame, found: DataFrame, parts: int) -> DataFrame:
    """labels (id, component) after more links: the components of the components."""
    if found.isEmpty():
        return labels
    at = [labels.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")) for c in "ab"]
    j = found.join(at[0], "a", "left").join(at[1], "b", "left")
    step = connected_components(j.select(F.coalesce("ca", "a").alias("src"), F.coalesce("cb", "b").alias("dst")), parts=parts)
    new = found.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(labels, "id", "left_anti").select("id", F.col("id").alias("component"))
    every = labels.unionByName(new).join(step.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    return cut(every.select("id", F.coalesce("to", "component").alias("component")), parts)


def _buckets(sigs: DataFrame, n: int) -> DataFrame:
    """no, size, key, leader (smallest number of the key) for the keys that several of the n signatures have."""
    members = sigs.select("no", "size", F.explode("keys").alias("key"))
    many = parts_of(sigs.sparkSession, BANDS * n)
    groups = cut(members.groupBy("key").agg(F.min("no").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1"), many)
    return cut(KeyFilter(groups, "key", groups.count()).maybe(members, "key").join(groups.select("key", "leader"), "key"), many)


def _star_links(near: DataFrame, sigs: DataFrame, classes: DataFrame, idf: Idf, threshold: float, least: int = MIN_AGREE) -> DataFrame:
    """a, b: verified links of the members of buckets with their leaders (step 4)."""
    star = near.filter("no <> leader").select(F.col("leader").alias("a"), F.col("no").alias("b")).distinct()
    return cut(verified(cut(_close_enough(star, sigs, least)), sigs, classes, idf, threshold).select("a", "b"))


def components(sigs: DataFrame, classes: DataFrame, idf: Idf, threshold: float) -> DataFrame:
    """id, component of all numbers of classes that have a link (steps 4 and 5 above)."""
    n = sigs.count()
    few, many = parts_of(sigs.sparkSession, n), parts_of(sigs.sparkSession, BANDS * n)
    near = _buckets(sigs, n)
    found = _star_links(near, sigs, classes, idf, threshold)
    labels = connected_components(found, "a", "b", few)
    of = near.join(labels.withColumnRenamed("id", "no"), "no", "left").withColumn("component", F.coalesce("component", "no"))
    mixed = of.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("key")
    return _merge(labels, cut(_open_links(cut(of.join(mixed, "key").drop("leader"), many), sigs, classes, idf, threshold), few), few)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sources: bool = False) -> DataFrame:
    """One row per document: doc_id, text_sha256, class_id (smallest id of its text), component (smallest id of its group) and kept (one row of each group).

    With `sources`, frequencies count near copies once.
    """
    bound_batches(docs.sparkSession)
    rows, own, classes = text_classes(docs, id_col, text_col)
    idf = document_frequencies(classes, own.count())
    if sources:
        idf = once_per_source(classes, idf)
    sigs = cut(signatures(classes, idf).withColumn("no", F.monotonically_increasing_id()))
    comps = components(sigs, classes, idf, threshold)
    of = comps.join(sigs.select(F.col("no").alias("id"), "digest"), "id").join(own, "digest").select("digest", "component", "first")
    keeper = of.groupBy("component").agg(F.min("first").alias("keeper"))
    n = rows.count()
    every = own.join(of.join(keeper, "component").select("digest", "keeper"), "digest", "left").select("digest", "n", "first", F.coalesce("keeper", "first").alias("keeper"))
    return join_hot(rows, cut(every, parts_of(docs.sparkSession, n)), "digest", "n", n).select(
        "doc_id",
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("first")["doc_id"].alias("class_id"),
        F.col("keeper")["doc_id"].alias("component"),
        (F.col("row") == F.col("keeper")["row"]).alias("kept"),
    )
