"""SentencePiece models encoded and decoded by the tokenizers library.

`read_model` parses the protobuf of a .model file (wire format, the few fields needed), and `build` rebuilds
the tokenizer from it: normaliser (the precompiled character map, if there is one), dummy prefix and space
mark, unigram scores or - for BPE models - merges in the order of scores, and byte fallback.

Texts are encoded slice by slice (SLICE_BYTES), in batches by the library's own threads.  If no piece has the space mark
or a line feed behind another character (read off the vocabulary) and texts are not normalised, no token can reach over
the start of a word; then the distinct words of a slice go to the library, SEQUENCE of them in a sequence, and each
text's ids are those of its words, put together in flat arrays.  Nothing is remembered from one slice to the next, so
memory follows the slice.  Otherwise, and for texts with a literal space mark, each text is one sequence of a batch.

Parity: when asked to, `encode` also encodes with the sentencepiece library, the same words or whole texts, and reports
for every text whether the ids are equal: where words are independent, those of a text are equal if those of its words are.
All ids are decoded again, likewise, and compared with the text.

Round trips: a literal space mark in a text decodes to a space, as in the library itself; `round_trip` says so.

Defined cases: null text counts as empty (no ids, decodes to ""); a very long text is a slice of its own; repeated rows
give repeated results, null ids are kept; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import bound_batches
from recordloom.llm.shingling import flat_bytes, release, slices

MARK = "▁"
#: Fixed values of the public model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Bytes of text of a slice, words of a sequence, and sequences of a batch; they bound the memory of a worker.
SLICE_BYTES, SEQUENCE, BATCH = 4_000_000, 512, 64
#: Threads of the tokenizers library in a worker, where its own variable does not say otherwise.
THREADS = 2


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one protobuf message."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < n:
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        elif wire == 2:
            size = varint()
            at += size
            yield key >> 3, data[at - size : at]
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            at += size
            yield key >> 3, data[at - size : at]
        else:
            raise ValueError(f"wire type {wire}")


def read_model(path: str) -> Model:
    m = Model()
    with open(path, "rb") as f:
        data = f.read()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    (score,) = struct.unpack("<f", v)
                elif n == 3:
                    kind = v
            m.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    m.kind = v
                elif n == 35:
                    m.byte_fallback = bool(v)
                elif n == 40:
                    m.unk_id = v
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    m.charsmap = v
                elif n == 3:
                    m.add_dummy_prefix = bool(v)
                elif n == 4:
                    m.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    m.escape_whitespaces = bool(v)
    return m


def merges_of(m: Model) -> list[tuple[str, str]]:
    """BPE merges: a piece is merged from any two pieces that spell it; better scores first."""
    usable = {p for p, _, k in m.pieces if k in (NORMAL, USER_DEFINED, UNUSED)}
    place = {p: i for i, (p, _, _) in enumerate(m.pieces)}
    out = []
    for p, score, kind in m.pieces:
        if kind == NORMAL and len(p) > 1:
            splits = [(p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
            out += [(-score, place[p], place[a], place[b], a, b) for a, b in splits]
    return [(a, b) for *_, a, b in sorted(out)]


def build(m: Model):
    """The same tokenizer for the tokenizers library."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    if m.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in m.pieces], unk_id=m.unk_id, byte_fallback=m.byte_fallback)
    elif m.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
        model = models.BPE(vocab, merges_of(m), unk_token=m.pieces[m.unk_id][0], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError(f"model kind {m.kind}")
    t = Tokenizer(model)
    steps = []
    if m.charsmap:
        steps.append(normalizers.Precompiled(m.charsmap))
    if m.remove_extra_whitespaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    t.normalizer = normalizers.Sequence(steps)
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.add_dummy_prefix else [])])
    own = [AddedToken(p, normalized=False) for p, _, k in m.pieces if k == USER_DEFINED]
    if own:
        t.add_tokens(own)
    return t


@lru_cache(maxsize=4)
def tokenizer(path: str):
    return build(read_model(path))


@lru_cache(maxsize=4)
def _reference(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=4)
def _word_encoder(path: str):
    """The tokenizer for single words (no normaliser, no blank stripped), if words are independent of each other; else None."""
    from tokenizers import decoders

    m = read_model(path)
    joined = any(MARK in p.lstrip(MARK) or ("\n" in p and p != "\n") for p, _, k in m.pieces if k != BYTE)
    own = any(k == USER_DEFINED for _, _, k in m.pieces)
    if joined or own or m.charsmap or m.remove_extra_whitespaces or not m.add_dummy_prefix or m.kind != BPE:
        return None
    t = build(m)
    t.normalizer = None
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    return t


def word_bounds(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where words begin, with the end: at texts, at the first of some blanks, at line feeds and behind them."""
    begin, blank = np.zeros(len(data) + 1, bool), data == ord(" ")
    begin[0 : len(data)] = blank
    begin[1 : len(data)] &= ~blank[:-1]
    feed = np.flatnonzero(data == ord("\n"))
    begin[feed] = begin[feed + 1] = begin[at] = True
    return np.flatnonzero(begin)


@dataclass
class Encoded:
    """Flat ids of consecutive texts, where each text's begin, with the end, whether they decode to it, and whether the sentencepiece library gives the same."""

    ids: np.ndarray
    at: np.ndarray
    back: np.ndarray
    same: np.ndarray | None

    def lists(self) -> list[list[int]]:
        return [self.ids[i:j].tolist() for i, j in zip(self.at[:-1], self.at[1:], strict=True)]


def _by_words(path: str, texts: pa.Array, parity: bool) -> Encoded:
    """Texts by their distinct words; none has a literal space mark, and none is null or empty."""
    t = _word_encoder(path)
    # The blank before each text stands for the dummy prefix.
    data, at = flat_bytes(pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)))
    bounds = word_bounds(data, at)
    words = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    code, known = words.indices.to_numpy(), words.dictionary
    alone = t.encode("\n", add_special_tokens=False).ids
    feed = alone[-1]
    line = pc.index(known, pa.scalar("\n", known.type)).as_py()
    # Sequences of words with line feeds between them, which no token reaches over; the word of a line feed has no ids then.
    ends = np.append(np.arange(0, len(known), SEQUENCE), len(known)).astype(np.int64)
    some = known if line < 0 else pc.if_else(pa.array(np.arange(len(known)) == line), pa.scalar("", known.type), known)
    plain = ["\n" + x + "\n" for x in pc.binary_join(pa.LargeListArray.from_arrays(ends, some), pa.scalar("\n", known.type)).to_pylist()]
    ids, sizes = [], []
    back, same = np.ones(len(known), bool), np.ones(len(known), bool)
    for i in range(0, len(plain), BATCH):
        batch = plain[i : i + BATCH]
        got = [e.ids for e in t.encode_batch_fast([MARK + x.replace(" ", MARK) for x in batch], add_special_tokens=False)]
        theirs = _reference(path).encode(batch, num_threads=1) if parity else got
        for k, x, own, other, text in zip(range(i, i + len(batch)), batch, got, theirs, t.decode_batch(got, skip_special_tokens=False), strict=True):
            flat = np.array(own, np.int32)
            feeds = np.flatnonzero(flat == feed)
            of = slice(ends[k], ends[k + 1])
            if text[1:] != x:
                back[of] = [a == b for a, b in zip(text.split("\n")[1:-1], x.split("\n")[1:-1], strict=True)]
            if other != own:
                its = np.array(other, np.int32)
                stops = np.flatnonzero(its == feed)
                same[of] = [np.array_equal(flat[a:b], its[c:d]) for a, b, c, d in zip(feeds[:-1], feeds[1:], stops[:-1], stops[1:], strict=True)]
            sizes.append(np.diff(feeds) - 1)
            ids.append(np.delete(flat, np.append(np.arange(feeds[0]), feeds)))
    size, pool = np.concatenate(sizes), np.concatenate(ids)
    start = np.cumsum(size) - size
    if line >= 0:
        size[line], start[line], pool = 1, len(pool), np.append(pool, np.int32(feed))
    first = np.searchsorted(bounds, at)
    many = size[code]
    end = np.cumsum(many)
    where = np.append(0, end)[first]
    flat = pool[np.repeat(start[code] - (end - many), many) + np.arange(end[-1])]
    every = (np.logical_and.reduceat(x[code], first[:-1]) for x in (back, same))
    return Encoded(flat, where, next(every), next(every) if parity else None)


def _by_texts(path: str, texts: list[str], parity: bool) -> Encoded:
    """Each text as a sequence of its own."""
    ids = [e.ids for i in range(0, len(texts), BATCH) for e in tokenizer(path).encode_batch_fast(texts[i : i + BATCH], add_special_tokens=False)]
    same = np.array([x == y for x, y in zip(_reference(path).encode(texts, num_threads=1), ids, strict=True)], bool) if parity else None
    back = np.array([x == y for x, y in zip(decode_ids(path, ids), texts, strict=True)], bool)
    at = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int64)
    return Encoded(np.fromiter((i for x in ids for i in x), np.int32, at[-1]), at, back, same)


def codec(path: str, texts: pa.Array, parity: bool = False) -> Encoded:
    """Texts (strings; null is empty) encoded, decoded again and, if asked for, held against the sentencepiece library."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    alone = pc.match_substring(texts, MARK).to_numpy(zero_copy_only=False) if _word_encoder(path) else size > 0
    parts = [(np.flatnonzero(alone & (size > 0)), lambda x: _by_texts(path, x.to_pylist(), parity)), (np.flatnonzero(~alone & (size > 0)), lambda x: _by_words(path, x, parity))]
    many, back, same = np.zeros(len(texts), np.int64), np.ones(len(texts), bool), np.ones(len(texts), bool)
    got = []
    for rows, run in parts:
        if len(rows):
            e = run(texts if len(rows) == len(texts) else texts.take(pa.array(rows)))
            if len(rows) == len(texts):
                return e
            many[rows], back[rows] = np.diff(e.at), e.back
            if parity:
                same[rows] = e.same
            got.append((rows, e))
    at = np.append(0, np.cumsum(many))
    ids = np.empty(at[-1], np.int32)
    for rows, e in got:
        ids[np.repeat(at[rows] - e.at[:-1], many[rows]) + np.arange(len(e.ids))] = e.ids
    return Encoded(ids, at, back, same if parity else None)


def encode_texts(path: str, texts: list[str]) -> list[list[int]]:
    return codec(path, pa.array(texts, pa.large_string())).lists()


def decode_ids(path: str, ids: list[list[int]]) -> list[str]:
    return tokenizer(path).decode_batch(ids, skip_special_tokens=False)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", parity: bool = False) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip (decoding gives the text) and parity (equals the sentencepiece library; null if not asked for)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        for b in batches:
            for i, part in slices(b.column(1), SLICE_BYTES):
                e = codec(path, part, parity)
                same = pa.array(e.same) if parity else pa.nulls(len(part), pa.bool_())
                lists = pa.ListArray.from_arrays(pa.array(e.at, pa.int32()), pa.array(e.ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, len(part)), lists, pa.array(np.diff(e.at)), pa.array(e.back), same], ["doc_id", "ids", "n_tokens", "round_trip", "parity"])
        release()

    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, n_tokens bigint, round_trip boolean, parity boolean")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text; null ids decode to an empty text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(decode_ids(path, [[] if x is None else list(map(int, x)) for x in b]), dtype=object)

    return encoded.select(F.col(id_col).alias("doc_id"), F.pandas_udf(run, "string")(F.col(ids_col)).alias("text"))
