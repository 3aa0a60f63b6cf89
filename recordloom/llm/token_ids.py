"""Ids of whole texts by a tokenizers file, as flat arrays.

For tokenizers of the shape that `by_pieces` proves from the file (composition, white space, lower case; letters, single
digits and runs of other signs as words of their own; byte-level pairs with word ends; special strings matched as they
are), texts are cut at ASCII blanks, which no word reaches over, and words of ASCII and Latin-1 letters, digits and signs
into the pieces that the library would cut them into.  Each distinct piece of a slice goes to the library once, all of them in
a few long calls, and what a worker has learned is kept for its next slices, up to a number of entries.  Words with
anything else (other letters, an apostrophe, the start of a special string) go to the library whole, with its normaliser.
For other files, each text goes to the library.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces that a worker keeps; beyond that it forgets all and begins again.
MEMORY = 600_000
CALL = 2_000
#: The pattern of the words, and what stands before the pairs, of the files that are cut into pieces.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
BLANKS = " \t\n\v\f\r"
BLANK, LETTER, DIGIT, SIGN, ODD = range(5)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=4)
def by_pieces(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    steps = (t["pre_tokenizer"] or {}).get("pretokenizers", [])
    plain = all(x["content"][:2] == "<|" and not (x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"]) for x in t["added_tokens"])
    split = len(steps) == 2 and steps[0] == {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True} and steps[1]["type"] == "ByteLevel" and not (steps[1]["add_prefix_space"] or steps[1]["use_regex"])
    m = t["model"]
    return plain and split and (t["normalizer"] or {}).get("normalizers") == NORMAL and m["type"] == "BPE" and m["end_of_word_suffix"] == "</w>" and not (m["dropout"] or m["continuing_subword_prefix"] or m["ignore_merges"])


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    kinds = np.full(256, ODD, np.uint8)
    kinds[0:128] = SIGN
    kinds[[*b"\t\n\v\f\r "]] = BLANK
    kinds[[*b"0123456789"]] = DIGIT
    kinds[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = LETTER
    kinds[ord("'")] = ODD
    return kinds


def _cut(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes in lower case but for odd words, and where pieces begin, with the end; a run of blanks is a piece too."""
    kind = _kinds()[data]
    low = np.where((data >= ord("A")) & (data <= ord("Z")), data + np.uint8(32), data)
    lead = np.flatnonzero(data[:-1] == 0xC3)  # Latin-1 letters but for the signs of times and division
    after = data[lead + 1]
    lead = lead[(after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    after = data[lead + 1]
    low[lead + 1] = np.where(after < 0x9F, after + np.uint8(32), after)
    opening = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
    kind[opening] = ODD
    blank = kind == BLANK
    begin = np.ones(len(data) + 1, bool)
    begin[1:-1] = blank[1:] != blank[:-1]
    begin[at] = True
    words = np.flatnonzero(begin)
    odd = np.flatnonzero(kind == ODD)
    begin[1:-1] |= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    if len(odd):  # words with an odd byte stay whole, and as they are
        of = np.unique(np.searchsorted(words, odd, "right")) - 1
        size = words[of + 1] - words[of]
        inside = np.repeat(words[of] - np.cumsum(size) + size, size) + np.arange(size.sum())
        begin[inside], low[inside] = False, data[inside]
        begin[words[of]] = True
    return low, np.flatnonzero(begin)


class Pieces:
    """Ids of pieces that a worker has seen."""

    def __init__(self, path: str):
        from tokenizers import pre_tokenizers

        self.full, self.plain = tokenizer(path), type(tokenizer(path)).from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit(" "), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.full.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Entry 0 is what has no ids."""
        self.known: dict[str, int] = {}
        self.sizes, self.pool = np.zeros(1, np.int64), np.zeros(0, np.int32)

    @staticmethod
    def _odd(piece: str) -> bool:
        return "'" in piece or "<|" in piece or not (piece.isascii() or all(c.isascii() or ("ß" <= c <= "ÿ" and c != "÷") for c in piece))

    def learn(self, pieces: list[str]) -> None:
        odd, plain, sizes, pool = [], [], [self.sizes], [self.pool]
        for x in pieces:
            (odd if self._odd(x) else plain).append(x)
        for i in range(0, len(odd), CALL):
            got = [e.ids for e in self.full.encode_batch_fast(odd[i : i + CALL], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            pool.append(np.fromiter((k for x in got for k in x), np.int32))
        for i in range(0, len(plain), CALL):
            pool.append(np.array(self.plain.encode(" ".join(plain[i : i + CALL]), add_special_tokens=False).ids, np.int32))
            sizes.append(np.diff(np.flatnonzero(self.ends[pool[-1]]), prepend=-1))
        self.known.update(zip(odd + plain, range(len(self.sizes), len(self.sizes) + len(pieces)), strict=True))
        self.sizes, self.pool = np.concatenate(sizes), np.concatenate(pool)

    def codes(self, pieces: list[str]) -> np.ndarray:
        """Entries of pieces; their ids stand in `pool` one behind the other, as many as `sizes` has."""
        if len(self.known) > MEMORY:
            self.forget()
        new = [x for x in pieces if x not in self.known and x.strip(BLANKS)]
        if new:
            self.learn(new)
        return np.fromiter((self.known.get(x, 0) for x in pieces), np.int64, len(pieces))


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def ids_of(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of texts (null is empty), as the library gives them without special tokens added, and where each text's begin, with the end."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not by_pieces(path):
        got = [e.ids for e in tokenizer(path).encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        return np.fromiter((i for x in got for i in x), np.int32), np.append(0, np.cumsum([len(x) for x in got], dtype=np.int64)).astype(np.int64)
    # A line feed behind each text keeps neighbours apart.
    joined = pc.binary_join_element_wise(texts, pa.scalar("\n", texts.type), pa.scalar("", texts.type))
    at = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    at = at - at[0]
    low, bounds = _cut(data, at)
    pieces = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(low)]).dictionary_encode()
    memory = _pieces(path)
    entry = memory.codes(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
    of = entry[pieces.indices.to_numpy()]
    many = memory.sizes[of]
    end = np.cumsum(many)
    first = np.append(0, end)[np.searchsorted(bounds, at)]
    return memory.pool[np.repeat((np.cumsum(memory.sizes) - memory.sizes)[of] - (end - many), many) + np.arange(end[-1])], first
