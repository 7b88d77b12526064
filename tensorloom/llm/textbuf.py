"""Vectorised access to the bytes of a batch of texts.

An Arrow string column is one byte buffer with offsets. The helpers here find words in
that buffer, hash them with prefix sums and look their encodings up in a table, without a
Python step for every word. Batches are cut into slices of whole texts, so that the numpy
temporaries stay small however large a batch is.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
#: The six ASCII white-space bytes that separate words.
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_BASE = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_power = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base modulo 2**64, and their inverses."""
    global _power, _inverse
    if len(_power) < n:
        size = max(n, SLICE_BYTES + 1)
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _power, _inverse = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _power, _inverse


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, budget: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets): whole texts, about budget bytes at once.

    A text longer than the budget makes a slice alone.
    """
    data, at = buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + budget, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def release() -> None:
    """Give freed memory back to the system; a worker that waits for its next task then holds its tables alone."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


def table_of(separators: bytes) -> np.ndarray:
    """256 booleans: whether a byte belongs to a run between separators."""
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


IN_WORD = table_of(SPACES)


def runs(data: np.ndarray, at: np.ndarray, inside: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of inside bytes that do not cross texts: (starts, ends, first run of each text)."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(at), np.int64)
    word = inside[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    start = word.copy()
    start[1:] &= ~word[:-1] | edge[1:n]
    end = word.copy()
    end[:-1] &= ~word[1:] | edge[1:n]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, at)


def run_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte run, from prefix sums of a polynomial modulo 2**64."""
    up, down = _powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * down[starts]
    return _mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def first_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first eight bytes of each run as an integer."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    view = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    short = np.minimum(ends - starts, 8).astype(np.uint64) * np.uint64(8)
    keep = np.where(short == 64, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (short % np.uint64(64))) - np.uint64(1))
    return view[starts] & keep


def ragged(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """flat[starts[i] : starts[i] + counts[i]] for all i, one after the other."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return flat[np.repeat(starts - before, counts) + np.arange(total)]


class Interner:
    """Encodings of byte runs, kept by (64-bit hash, length, first eight bytes).

    encode(list of bytes) gives (flat int32 array, counts). The table holds at most
    capacity runs; a full table is emptied, which costs time and never changes a result.
    Runs longer than longest are encoded each time and not kept.
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], capacity: int = 1 << 19, longest: int = 64):
        self.encode, self.capacity, self.longest = encode, capacity, longest
        self.mask = np.uint64(4 * capacity - 1)
        self._clear()

    def _clear(self) -> None:
        self.slot = np.full(4 * self.capacity, -1, np.int32)
        self.key = np.zeros(self.capacity, np.uint64)
        self.head = np.zeros(self.capacity, np.uint64)
        self.size = np.zeros(self.capacity, np.int32)
        self.start = np.zeros(self.capacity, np.int64)
        self.count = np.zeros(self.capacity, np.int64)
        self.flat = np.zeros(4 * self.capacity, np.int32)
        self.n = self.used = 0

    def _find(self, h: np.ndarray, head: np.ndarray, size: np.ndarray) -> np.ndarray:
        found = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        place = h & self.mask
        while len(left):
            e = self.slot[place]
            there = e >= 0
            same = there & (self.key[e] == h[left]) & (self.head[e] == head[left]) & (self.size[e] == size[left])
            found[left[same]] = e[same]
            more = there & ~same
            left, place = left[more], (place[more] + np.uint64(1)) & self.mask
        return found

    def _add(self, h: np.ndarray, head: np.ndarray, size: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        n = len(h)
        if self.n + n > self.capacity:
            self._clear()
        ids = np.arange(self.n, self.n + n)
        self.key[ids], self.head[ids], self.size[ids] = h, head, size
        self.count[ids], self.start[ids] = counts, self.used + np.cumsum(counts) - counts
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.n, self.used = self.n + n, self.used + len(flat)
        left, place = ids, h & self.mask
        while len(left):
            free = np.flatnonzero(self.slot[place] < 0)
            _, one = np.unique(place[free], return_index=True)
            won = free[one]
            self.slot[place[won]] = left[won]
            rest = np.ones(len(left), bool)
            rest[won] = False
            left, place = left[rest], (place[rest] + np.uint64(1)) & self.mask
        return ids

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat, starts in flat, counts) of the encoding of each run."""
        h, head, size = run_hash(data, starts, ends), first_bytes(data, starts, ends), (ends - starts).astype(np.int32)
        found = self._find(h, head, size)
        miss = np.flatnonzero(found < 0)
        if not len(miss):
            return self.flat, self.start[found], self.count[found]
        raw = data.tobytes()
        short = miss[size[miss] <= self.longest]
        _, one, back = np.unique(h[short], return_index=True, return_inverse=True)
        same = short[one][back]
        odd = (head[same] != head[short]) | (size[same] != size[short])  # hashes that meet: encoded alone
        long = np.concatenate([miss[size[miss] > self.longest], short[odd]])
        new = short[one]
        if len(new) > self.capacity // 2 or self.n + len(new) > self.capacity:
            flat0, start0, count0 = self.flat, self.start[found], self.count[found]
            if len(new) <= self.capacity // 2:
                self._clear()
        else:
            flat0 = None
        flat, counts = self.encode([raw[starts[i] : ends[i]] for i in new]) if len(new) else (np.empty(0, np.int32), np.empty(0, np.int64))
        if flat0 is None:
            ids = self._add(h[new], head[new], size[new], flat, counts)
            found[short] = ids[back]
            flat0, start0, count0 = self.flat, self.start[found], self.count[found]
        else:
            if len(new) <= self.capacity // 2:
                self._add(h[new], head[new], size[new], flat, counts)
            at = len(flat0) + np.cumsum(counts) - counts
            flat0, start0[short], count0[short] = np.concatenate([flat0, flat]), at[back], counts[back]
        if len(long):
            flat, counts = self.encode([raw[starts[i] : ends[i]] for i in long])
            start0[long], count0[long] = len(flat0) + np.cumsum(counts) - counts, counts
            flat0 = np.concatenate([flat0, flat.astype(np.int32)])
        return flat0, start0, count0
