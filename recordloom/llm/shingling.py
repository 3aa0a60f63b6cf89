"""Word shingles of whole batches of texts: Arrow buffers in, flat numpy arrays out, no Python object per word.

Words are runs of letters, digits and characters outside ASCII, lower-cased.  A word's hash reads its UTF-8 bytes
eight at a time; a shingle's hash mixes those of WORDS consecutive words.  A text of fewer words is one shingle of all.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 4_000_000
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[ord("0") : ord("9") + 1] = _IS_WORD[ord("a") : ord("z") + 1] = _IS_WORD[128:] = True
#: The low k bytes of a word of eight.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def release() -> None:
    """Give freed memory back to the system at the end of a task: a worker that is used again would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A published 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def lower(texts: pa.Array) -> pa.Array:
    """Lower-cased texts; null is empty.  A text that is no valid UTF-8 has its ASCII letters lower-cased."""
    texts = pc.fill_null(texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts, "")
    try:
        return pc.utf8_lower(texts)
    except pa.ArrowInvalid:
        if len(texts) == 1:
            return pc.ascii_lower(texts)
        return pa.concat_arrays([lower(texts.slice(i, 1)) for i in range(len(texts))])


def flat_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array without nulls, and where each text begins, with the end."""
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Consecutive parts of about `most` bytes each, with the place of their first text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    i, base = 0, 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, base + most, "right")))
        yield i, texts.slice(i, j - i)
        i, base = j, int(ends[j - 1])


def word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the place of the first word of each text, with the end."""
    n = len(data)
    inside = _IS_WORD[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = at[(at > 0) & (at < n)]
    begin[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    where = np.flatnonzero(begin)
    size = np.flatnonzero(last) + 1 - where
    if not len(where):
        return np.zeros(0, _U), np.zeros(len(at), np.int64)
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    # Eight bytes from any place on, as one number.
    eight = np.ndarray((n + 1,), "<u8", buffer=padded.data, strides=(1,))
    h = mix((eight[where] & _LOW[np.minimum(size, 8)] ^ size.astype(_U)) * _ODD)
    rest, k = np.flatnonzero(size > 8), 8
    while len(rest):
        h[rest] = mix(h[rest] * _ODD + (eight[where[rest] + k] & _LOW[np.minimum(size[rest] - k, 8)]))
        k += 8
        rest = rest[size[rest] > k]
    return h, np.searchsorted(where, at)


@dataclass
class Shingled:
    """Distinct shingles of consecutive texts, sorted within each: hashes, occurrences, and where each text begins, with the end."""

    hashes: np.ndarray
    times: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def one(self, i: int) -> slice:
        return slice(self.at[i], self.at[i + 1])


def _windows(h: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words that begin at `first`."""
    s = np.full(len(first), k, _U)
    for j in range(k):
        s = mix(s * _ODD + h[first + j])
    return s


def shingle(texts: pa.Array) -> Shingled:
    h, at = word_hashes(*flat_bytes(lower(texts)))
    count = np.diff(at)
    many = np.where(count >= WORDS, count - WORDS + 1, np.minimum(count, 1))
    begin = np.concatenate(([0], np.cumsum(many)))
    # The first word of every shingle: its text's first one and the shingle's number.
    first = np.repeat(at[:-1] - begin[:-1], many) + np.arange(begin[-1])
    s = np.empty(len(first), _U)
    size = np.repeat(np.minimum(count, WORDS), many)
    for k in range(1, WORDS + 1):
        own = slice(None) if k == WORDS and (size == WORDS).all() else np.flatnonzero(size == k)
        s[own] = _windows(h, first[own], k)
    for i, j in zip(begin[:-1].tolist(), begin[1:].tolist()):
        s[i:j].sort()
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    new[begin[:-1][many > 0]] = True
    kept = np.flatnonzero(new)
    return Shingled(s[kept], np.diff(np.append(kept, len(s))).astype(np.float64), np.searchsorted(kept, begin))
