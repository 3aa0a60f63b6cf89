"""Token counts of whole texts, with huge documents encoded in overlapping chunks that are resynchronised.

A text of over `chunk` characters is cut into chunks that overlap.  Each is encoded with offsets, and two
neighbours are spliced at a common boundary: a character position in the overlap where both have a token
boundary and that is stable, i.e. no token of the vocabulary can reach across it.  For a vocabulary whose
pieces have the space mark only at their start (proven by reading all pieces, see `cuts_before_space`), every
position between a character other than a space and a space is stable.  If the overlap has no such position,
it is widened, up to the whole rest of the text, so the result is that of the whole text.

Tokenizers: `.model` files through sentencepiece, `.json` files through tokenizers.  For those, or if the
vocabulary gives no proof, texts are encoded whole.

Defined cases: null text counts as empty (0 tokens); repeated rows give repeated results; an empty table gives
no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import bound_batches
from recordloom.llm.sentencepiece_codec import USER_DEFINED, read_model

CHUNK, OVERLAP = 16_384, 512
MARK = "▁"


@lru_cache(maxsize=4)
def load(path: str):
    """The library's tokenizer for a file, with its defaults but no truncation or padding."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def cuts_before_space(path: str) -> bool:
    """Whether no piece has the space mark after another character, and text is taken as it is behind one blank: all read from the model file."""
    if not path.endswith(".model"):
        return False
    m = read_model(path)
    taken = not m.charsmap and not m.remove_extra_whitespaces and m.add_dummy_prefix and m.escape_whitespaces
    return taken and not any(MARK in p.lstrip(MARK) or k == USER_DEFINED for p, _, k in m.pieces)


def count_whole(path: str, texts: list[str]) -> list[int]:
    t = load(path)
    if path.endswith(".model"):
        return [len(x) for x in t.encode(texts, num_threads=1)] if texts else []
    return [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]


def _starts(path: str, text: str) -> list[int]:
    """Character positions at which tokens of `text` start (the mark put before it stands at 0)."""
    return [int(a) for a, _ in load(path).encode(text, return_type="offset_mapping")["offsets"]] if text else []


def stable_cut(text: str, low: int, high: int) -> int | None:
    """The last position in low..high-1 between a non-space and a space; chunks may be spliced there."""
    at = high
    while (at := text.rfind(" ", low + 1, at)) > 0:
        if text[at - 1] not in (" ", MARK):
            return at
    return None


def count_chunked(path: str, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a huge text by overlap resynchronisation."""
    if len(text) <= chunk or not cuts_before_space(path):
        return count_whole(path, [text])[0]
    total, begin, n = 0, 0, len(text)
    while True:
        end, width = min(n, begin + chunk), overlap
        if end == n:
            return total + len(_encoded(path, text, begin, n))
        here = None
        while True:
            # This chunk reaches `width` characters into the next one.
            stop = min(n, end + width)
            cut = stable_cut(text, max(begin + 1, end), stop)
            if cut is not None:
                here = _encoded(path, text, begin, stop)
                k = here.index_of(cut)
                # The next chunk starts at the cut; both have a boundary there.
                if k is not None:
                    total += k
                    begin = cut
                    break
            if stop == n:
                return total + len(here if here is not None else _encoded(path, text, begin, n))
            width *= 4


class _Encoded:
    """Token starts of text[begin:end], as if it followed what precedes it."""

    def __init__(self, starts: list[int], begin: int):
        self.starts, self.begin = starts, begin

    def __len__(self) -> int:
        return len(self.starts)

    def index_of(self, position: int) -> int | None:
        """Number of tokens before the boundary at `position`, if there is one."""
        from bisect import bisect_left

        k = bisect_left(self.starts, position - self.begin)
        return k if k < len(self.starts) and self.starts[k] == position - self.begin else None


def _encoded(path: str, text: str, begin: int, end: int) -> _Encoded:
    # The library puts a space before a text; a later chunk starts with a space of its own, which takes that place.
    if begin == 0:
        return _Encoded(_starts(path, text[:end]), 0)
    starts = _starts(path, text[begin + 1 : end])
    return _Encoded([0, *(s + 1 for s in starts[1:])] if starts else [0], begin)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit.  path: of the tokenizer file, present on every executor."""

    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = [0] * len(texts)
            # Small texts go to the library in slices, so memory follows the slice and not the batch.
            small, size = [], 0
            values = texts.tolist()
            for i, t in enumerate(values):
                if len(t) > chunk:
                    out[i] = count_chunked(path, t, chunk, overlap)
                else:
                    small.append(i)
                    size += len(t)
                if size > 1_000_000 or (i == len(values) - 1 and small):
                    for j, c in zip(small, count_whole(path, [values[j] for j in small]), strict=True):
                        out[j] = c
                    small, size = [], 0
            yield pd.Series(out, dtype="int64")

    bound_batches(docs.sparkSession)
    n_tokens = F.pandas_udf(counts, "long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), n_tokens("text").alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)
