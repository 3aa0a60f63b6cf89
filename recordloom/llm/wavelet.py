"""Wavelet matrix of a sequence of token ids: compressed bit-planes in one byte string, with access, rank, select and counting.

Plane l holds bit (planes - 1 - l) of each id, in an order that starts as the sequence and, from plane to plane, puts those
with a 0 before those with a 1, each in their old order.  So the ids equal to c are one interval behind the last plane, and
an id's place is followed from plane to plane by counting the ones before it (`rank`), backwards by finding the k-th one
(`select`).

File: magic, then n, planes, bits of a block and bytes of an id as unsigned 32-bit integers (n as 64), the zeros of each
plane, for each plane the ones before each block and where each block's bytes begin, then the blocks.  A block is kept as
it is or packed by zstd, whichever is shorter.  Everything but the blocks in use stays packed while it is read.

Defined cases: an empty sequence has no blocks; an id that does not occur counts 0 and has no occurrences; places outside of
the sequence are an IndexError.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

MAGIC = b"WVM1"
BLOCK = 1 << 16
HEAD = np.dtype([("magic", "S4"), ("planes", "<u4"), ("block", "<u4"), ("width", "<u4"), ("n", "<u8")])


def build(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """The file of a sequence of unsigned 16 or 32-bit ids.  block: bits of a block, a multiple of 8."""
    seq = np.ascontiguousarray(ids)
    n, width = len(seq), seq.dtype.itemsize
    planes = max(1, int(seq.max()).bit_length()) if n else 1
    blocks = -(-n // block)
    zeros, before, packed, sizes = np.zeros(planes, "<u8"), np.zeros((planes, blocks + 1), "<u8"), [], np.zeros(planes * blocks + 1, "<u8")
    pack = zstandard.ZstdCompressor(level=1, write_content_size=False, write_checksum=False)
    for level in range(planes):
        plane = np.packbits((seq & seq.dtype.type(1 << (planes - 1 - level))).astype(bool), bitorder="little")
        step = block // 8
        counts = np.add.reduceat(np.bitwise_count(plane), np.arange(0, len(plane), step), dtype=np.int64) if n else []
        before[level, 1:] = np.cumsum(counts)
        zeros[level] = n - int(before[level, -1])
        for k in range(blocks):
            raw = plane[k * step : (k + 1) * step].tobytes()
            tight = pack.compress(raw)
            packed.append(tight if len(tight) < len(raw) else raw)
            sizes[1 + level * blocks + k] = len(packed[-1])
        ones = pa.BooleanArray.from_buffers(pa.bool_(), n, [None, pa.py_buffer(plane)])
        parts = [pa.array(seq).filter(mask) for mask in (pc.invert(ones), ones)]
        seq = pa.concat_arrays(parts).to_numpy()
    head = np.array((MAGIC, planes, block, width, n), HEAD).tobytes()
    return b"".join([head, zeros.tobytes(), before.tobytes(), np.cumsum(sizes, dtype="<u8").tobytes(), *packed])


class Wavelet:
    """A file read back.  data: anything with a buffer."""

    def __init__(self, data):
        self.data = memoryview(data).cast("B")
        head = np.frombuffer(self.data, HEAD, 1)[0]
        if head["magic"] != MAGIC:
            raise ValueError("not a wavelet file")
        self.n, self.planes, self.block = int(head["n"]), int(head["planes"]), int(head["block"])
        self.dtype = np.dtype(f"<u{int(head['width'])}")
        self.blocks = -(-self.n // self.block)
        at = HEAD.itemsize
        self.zeros = np.frombuffer(self.data, "<u8", self.planes, at).astype(np.int64)
        at += 8 * self.planes
        self.before = np.frombuffer(self.data, "<u8", self.planes * (self.blocks + 1), at).astype(np.int64).reshape(self.planes, -1)
        at += 8 * self.planes * (self.blocks + 1)
        self.begins = np.frombuffer(self.data, "<u8", self.planes * self.blocks + 1, at).astype(np.int64) + at + 8 * (self.planes * self.blocks + 1)
        self._unpack = zstandard.ZstdDecompressor()
        self._held = lru_cache(maxsize=2 * self.planes)(self._bytes)

    def __len__(self) -> int:
        return self.n

    def _bytes(self, level: int, k: int) -> np.ndarray:
        i = level * self.blocks + k
        raw = self.data[self.begins[i] : self.begins[i + 1]]
        size = -(-(min(self.n, (k + 1) * self.block) - k * self.block) // 8)
        return np.frombuffer(raw if len(raw) == size else self._unpack.decompress(raw, max_output_size=size), np.uint8)

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before place i."""
        k, r = divmod(i, self.block)
        if not r:
            return int(self.before[level, k])
        part = self._held(level, k)
        whole, rest = divmod(r, 8)
        more = int(part[whole]) & ((1 << rest) - 1) if rest else 0
        return int(self.before[level, k]) + int(np.bitwise_count(part[:whole]).sum()) + more.bit_count()

    def _find(self, level: int, j: int, one: bool) -> int:
        """Place of the j-th (from 0) one or zero of a plane."""
        ends = self.before[level] if one else np.minimum(np.arange(self.blocks + 1) * self.block, self.n) - self.before[level]
        k = int(np.searchsorted(ends, j, "right")) - 1
        bits = np.unpackbits(self._held(level, k), count=min(self.block, self.n - k * self.block), bitorder="little")
        return k * self.block + int(np.flatnonzero(bits == one)[j - int(ends[k])])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.planes):
            ones = self._ones(level, i)
            bit = self._ones(level, i + 1) - ones
            i = int(self.zeros[level]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _interval(self, c: int, i: int, j: int) -> tuple[int, int]:
        """Where the places i to j - 1 that hold c lie behind the last plane."""
        if c < 0 or c >> self.planes:
            return 0, 0
        for level in range(self.planes):
            a, b = self._ones(level, i), self._ones(level, j)
            i, j = (int(self.zeros[level]) + a, int(self.zeros[level]) + b) if c >> (self.planes - 1 - level) & 1 else (i - a, j - b)
        return i, j

    def rank(self, c: int, i: int) -> int:
        """How often c stands before place i."""
        if not 0 <= i <= self.n:
            raise IndexError(i)
        a, b = self._interval(c, 0, i)
        return b - a

    def count(self, c: int, begin: int = 0, end: int | None = None) -> int:
        """How often c stands in places begin to end - 1."""
        return self.rank(c, self.n if end is None else end) - self.rank(c, begin)

    def select(self, c: int, k: int) -> int:
        """Place of the k-th (from 0) c."""
        a, b = self._interval(c, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at = a + k
        for level in reversed(range(self.planes)):
            one = bool(c >> (self.planes - 1 - level) & 1)
            at = self._find(level, at - int(self.zeros[level]) if one else at, one)
        return at

    def _plane(self, level: int) -> np.ndarray:
        bits = np.concatenate([self._bytes(level, k) for k in range(self.blocks)]) if self.blocks else np.zeros(0, np.uint8)
        return np.unpackbits(bits, count=self.n, bitorder="little").astype(bool)

    def occurrences(self, c: int) -> np.ndarray:
        """All places of c, rising: its interval followed back through the planes as a whole."""
        a, b = self._interval(c, 0, self.n)
        at = np.arange(a, b)
        for level in reversed(range(self.planes)) if b > a else ():
            one = bool(c >> (self.planes - 1 - level) & 1)
            at = np.flatnonzero(self._plane(level) == one)[at - int(self.zeros[level]) if one else at]
        return at

    def ids(self) -> np.ndarray:
        """The whole sequence, by undoing the planes from the last to the first."""
        seq = np.zeros(self.n, self.dtype)
        for level in reversed(range(self.planes)):
            ones, zeros = self._plane(level), int(self.zeros[level])
            out = np.empty_like(seq)
            out[~ones] = seq[:zeros]
            out[ones] = seq[zeros:] | self.dtype.type(1 << (self.planes - 1 - level))
            seq = out
        return seq
