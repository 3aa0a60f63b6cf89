"""Fill-in-the-middle documents: cuts at units found by a parallel scan of an automaton over chunks.

An automaton reads bytes by class and marks where units begin (`LINES`: a unit is a line with its line feed).  A chunk is
scanned without knowing the state in which it is entered: it emits, for each state, the state in which it ends and the units
that begin in it (`Summary`).  Summaries compose associatively (`then`), so the entry states and the units before every chunk
come from a fold over a document's few summaries.  A cut behind unit k is then found in the one chunk where unit k begins
(`Scan.begin_of`), which is all that is looked at again.

Texts of up to `chunk` bytes are one chunk and are cut in the pass that reads them, without a shuffle.  Longer ones are written
once and dealt out as chunks to many tasks; summaries, entry states and the requests for cuts are narrow tables, and the cuts come back by a
join on the text's digest.  Output and its way back are built from bytes by built-in functions.

Defined cases: null text counts as empty (plain); a null id is an empty string behind the seed; repeated rows give repeated
results; an empty table gives no rows; other columns of the input are ignored; a text that contains a mark stays plain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import bound_batches
from recordloom.session import scratch_path

MARKS = ("<P>", "<S>", "<M>")
CHUNK = 1 << 16


@dataclass(frozen=True)
class Automaton:
    """kinds: class of each byte; step[state][class]: the next state; starts[state][class]: whether a unit begins there.  State 0 is the first.

    Classes in `runs` may be read as one byte when repeated: they lead to the same state from there again, and begin no further unit.
    """

    kinds: tuple[int, ...]
    step: tuple[tuple[int, ...], ...]
    starts: tuple[tuple[bool, ...], ...]

    @property
    def runs(self) -> list[int]:
        states = range(len(self.step))
        return [k for k in range(len(self.step[0])) if all(self.step[self.step[s][k]][k] == self.step[s][k] and not self.starts[self.step[s][k]][k] for s in states)]


#: Lines: state 0 stands at the start of a line, state 1 within one.
LINES = Automaton(tuple(int(b == ord("\n")) for b in range(256)), ((1, 0), (1, 0)), ((True, True), (False, False)))


@dataclass(frozen=True)
class Summary:
    """For each state of entry, the state at the end and the units that begin."""

    to: tuple[int, ...]
    units: tuple[int, ...]

    def then(self, after: Summary) -> Summary:
        return Summary(tuple(after.to[s] for s in self.to), tuple(n + after.units[s] for s, n in zip(self.to, self.units, strict=True)))


class Scan:
    """Chunks that stand one behind the other in `data`, at `at` (with the end), each read from every state at once."""

    def __init__(self, automaton: Automaton, data: np.ndarray, at: np.ndarray):
        kind = np.array(automaton.kinds, np.uint8)[data]
        again = np.zeros(len(data), bool)
        if len(data):
            again[1:] = (kind[1:] == kind[:-1]) & np.isin(kind[1:], automaton.runs)
        again[at[:-1][at[:-1] < len(data)]] = False
        self.places = np.flatnonzero(~again)
        self.first = np.searchsorted(self.places, at)
        kind = kind[self.places]
        step, starts = np.array(automaton.step, np.int8), np.array(automaton.starts)
        states, n = step.shape[0], len(kind)
        #: State before each place, by state of entry: prefix compositions by doubling, which stop at the chunk's start.
        to = step[:, kind]
        lead = np.arange(n) - np.repeat(self.first[:-1], np.diff(self.first))
        d = 1
        # A place after which all states are one needs no look further back.
        while (open_ := np.flatnonzero((lead >= d) & (to != to[0]).any(0))).size:
            to[:, open_] = np.take_along_axis(to[:, open_], to[:, open_ - d].astype(np.intp), 0) if states > 1 else to[:, open_]
            d *= 2
        before = np.empty_like(to)
        before[:, 1:] = to[:, :-1]
        head = self.first[:-1][np.diff(self.first) > 0]
        before[:, head] = np.arange(states)[:, None]
        self.begins = np.stack([starts[before[s], kind] for s in range(states)])
        self.counted = np.concatenate([np.zeros((states, 1), np.int64), np.cumsum(self.begins, 1)], 1)
        self.units = self.counted[:, self.first[1:]] - self.counted[:, self.first[:-1]]
        full = np.diff(self.first) > 0
        self.to = np.tile(np.arange(states)[:, None], len(at) - 1)
        self.to[:, full] = to[:, self.first[1:][full] - 1]

    def summary(self, i: int) -> Summary:
        return Summary(tuple(self.to[:, i].tolist()), tuple(self.units[:, i].tolist()))

    def begin_of(self, state: np.ndarray, chunk: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Place in `data` where the k-th unit (from 0) of a chunk that is entered in `state` begins."""
        out = np.empty(len(k), np.int64)
        for s in range(len(self.begins)):
            of = state == s
            out[of] = self.places[np.searchsorted(self.counted[s], self.counted[s][self.first[chunk[of]]] + k[of], "right") - 1]
        return out


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column without nulls, and where each entry's begin, with the end."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _cut_whole(automaton: Automaton, column: pa.Array, h1: np.ndarray, h2: np.ndarray) -> pa.StructArray:
    """n, a, b of texts that are one chunk each: units, and the bytes before the two cuts."""
    data, at = _bytes(column)
    scan = Scan(automaton, data, at)
    n = scan.units[0]
    cuts = []
    for k in (np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))):
        place = np.diff(at).copy()  # behind the last unit
        inner = np.flatnonzero(k < n)
        place[inner] = scan.begin_of(np.zeros(len(inner), np.int64), inner, k[inner]) - at[inner]
        cuts.append(pa.array(place, pa.int64()))
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), *cuts], ["n", "a", "b"])


def _hashes(ident: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def _cut_giants(giants: DataFrame, automaton: Automaton, chunk: int) -> DataFrame:
    """key, n, a, b of texts of many chunks (giants: key, h1, h2, text); repeats of a key count once."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, text in zip(b.column(0), b.column(1), strict=True):
                raw = text.as_buffer()
                for k in range(0, len(raw), chunk):
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.binary()), pa.array([k // chunk]), pa.array([raw[k : k + chunk].to_pybytes()], pa.binary())], ["key", "no", "bytes"])

    spread = giants.select("key", "text").mapInArrow(deal, "key binary, no bigint, bytes binary").repartition(F.col("key"), F.col("no"))

    @F.arrow_udf("struct<to:array<int>,units:array<bigint>>")
    def summarise(part: pa.Array) -> pa.Array:
        scan = Scan(automaton, *_bytes(part))
        return pa.array([{"to": list((s := scan.summary(i)).to), "units": list(s.units)} for i in range(len(part))], pa.struct([("to", pa.list_(pa.int32())), ("units", pa.list_(pa.int64()))]))

    chunks = spread.select("key", "no", F.octet_length("bytes").alias("size"), summarise("bytes").alias("s")).groupBy("key", "no").agg(F.first("s").alias("s"), F.first("size").alias("size"))

    @F.arrow_udf("struct<units:bigint,at:array<struct<no:bigint,state:int,before:bigint,units:bigint>>>")
    def enter(parts: pa.Array) -> pa.Array:
        out = []
        for chunks in parts:
            so_far, at = Summary((0,), (0,)), []
            for c in chunks.as_py():
                summary = Summary(tuple(c["s"]["to"]), tuple(c["s"]["units"]))
                at.append({"no": c["no"], "state": so_far.to[0], "before": so_far.units[0], "units": summary.units[so_far.to[0]]})
                so_far = so_far.then(summary)
            out.append({"units": so_far.units[0], "at": at})
        return pa.array(out, pa.struct([("units", pa.int64()), ("at", pa.list_(pa.struct([("no", pa.int64()), ("state", pa.int32()), ("before", pa.int64()), ("units", pa.int64())])))]))

    gathered = chunks.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("no", "s"))).alias("chunks"), F.sum("size").alias("size"))
    folded = gathered.select("key", "size", enter("chunks").alias("f"))
    keyed = giants.select("key", "h1", "h2").distinct().join(folded, "key").select("key", "size", F.col("f.units").alias("n"), F.col("f.at").alias("at"), *[F.expr(f"h{i} % (f.units + 1)").alias(f"k{i}") for i in (1, 2)])
    ends = keyed.select("key", "size", "n", "at", F.least("k1", "k2").alias("ka"), F.greatest("k1", "k2").alias("kb"))
    asked = ends.select("key", "n", "at", "size", F.explode(F.array(*[F.struct(F.lit(x).alias("cut"), F.col(f"k{x}").alias("k")) for x in "ab"])).alias("r")).select(
        "key", "size", "n", "r.cut", "r.k", F.get(F.filter("at", lambda c: (c["before"] <= F.col("r.k")) & (F.col("r.k") < c["before"] + c["units"])), F.lit(0)).alias("c")
    )

    @F.arrow_udf("bigint")
    def select(part: pa.Array, state: pa.Array, k: pa.Array) -> pa.Array:
        scan = Scan(automaton, *_bytes(part))
        data_at = _bytes(part)[1][:-1]
        return pa.array(scan.begin_of(state.to_numpy(), np.arange(len(part)), k.to_numpy()) - data_at)

    at_chunk = asked.filter("c IS NOT NULL").select(F.col("key").alias("of"), F.col("c.no").alias("at_no"), "cut", F.col("c.state").alias("state"), (F.col("k") - F.col("c.before")).alias("k"))
    found = spread.join(at_chunk, (F.col("key") == F.col("of")) & (F.col("no") == F.col("at_no"))).select("key", "cut", (F.col("no") * chunk + select("bytes", "state", "k")).alias("place"))
    places = found.groupBy("key").agg(*[F.max(F.when(F.col("cut") == x, F.col("place"))).alias(x) for x in "ab"])
    return ends.select("key", "n", "size").join(places, "key", "left").select("key", "n", *[F.coalesce(x, "size").alias(x) for x in "ab"])


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, automaton: Automaton = LINES, chunk: int = CHUNK
) -> DataFrame:
    """doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars, output, text.  rate: per cent that are not plain; spm: per cent of those with the suffix first."""
    spark = docs.sparkSession
    bound_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    h = _hashes(F.col("doc_id"), seed)
    rows = rows.select("doc_id", "text", *[x.alias(f"h{i + 1}") for i, x in enumerate(h)])

    @F.arrow_udf("struct<n:bigint,a:bigint,b:bigint>")
    def cut_whole(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        return _cut_whole(automaton, text, h1.to_numpy(), h2.to_numpy())

    size = F.octet_length("text")
    small = rows.filter(size <= chunk).withColumn("c", cut_whole("text", "h1", "h2"))
    key = F.unhex(F.sha2(F.concat(F.lit("i").cast("binary"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.lit("\0").cast("binary"), F.col("text").cast("binary")), 256))
    path = scratch_path(spark, "long-texts")
    rows.filter(size > chunk).withColumn("key", key).write.parquet(path)
    giants = spark.read.parquet(path)
    cuts = _cut_giants(giants, automaton, chunk).select("key", F.struct("n", "a", "b").alias("c"))
    cut = small.unionByName(giants.join(cuts, "key").drop("key"))
    plain = (F.col("text") == "") | F.col("text").contains(MARKS[0]) | F.col("text").contains(MARKS[1]) | F.col("text").contains(MARKS[2]) | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    raw = F.col("text").cast("binary")
    part = lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int"))
    a, b = F.col("c.a"), F.col("c.b")
    parts = {"P": part(F.lit(0), a), "M": part(a, b), "S": part(b, size)}
    joined = lambda order: F.concat(*[x for m in order for x in (F.lit(f"<{m}>").cast("binary"), parts[m])]).cast("string")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", joined("PSM")).otherwise(joined("SPM"))
    chars = lambda m: F.when(F.col("form") != "plain", F.char_length(parts[m].cast("string")).cast("bigint"))
    return cut.withColumn("form", form).select("doc_id", F.col("c.n").alias("n"), "form", chars("P").alias("prefix_chars"), chars("M").alias("middle_chars"), output.alias("output"), "text")


def restore(output: Column, form: Column) -> Column:
    """The text of an output: its three parts, between the marks, in their order in the text."""
    parts = F.split(output, "<[PSM]>", -1)
    at = lambda i: F.element_at(parts, i)
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(2), at(4), at(3))).otherwise(F.concat(at(3), at(4), at(2)))
