"""Vectorised words, hashes and ragged arrays over Arrow batches of text."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: The separators of the contracts: space and \x09-\x0D. They are ASCII, so bytes of longer characters never match.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

_STEP = 4 << 20  # bytes split at a time


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; each output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets between them; a null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind, len(texts) + 1, texts.offset * kind().itemsize).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its task, and lies idle beside the next stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: int | str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of batches in slices of about `most` bytes of a text or binary column, a longer one alone."""
    try:
        yield from _sliced(batches, column, most)
    finally:
        give_back()


def _sliced(batches: Iterator[pa.RecordBatch], column: int | str, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lens = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends, lo = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)]), 0
        while lo < len(batch):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


@dataclass
class Words:
    """Runs of non-separator bytes; words of document d are ptr[d]:ptr[d + 1]."""

    data: np.ndarray
    docs: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    ptr: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def units(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans that cover each text: separators together with the word after them, and those at the end alone."""
        last = np.zeros(len(self.docs) - 1, np.int64)
        some = self.counts > 0
        last[some] = self.ends[self.ptr[1:][some] - 1]
        last[~some] = self.docs[:-1][~some]
        tail = last < self.docs[1:]
        owner = np.concatenate([np.repeat(np.arange(len(some)), self.counts), np.flatnonzero(tail)])
        ends = np.concatenate([self.ends, self.docs[1:][tail]])
        order = np.argsort(ends, kind="stable")
        owner, ends = owner[order], ends[order]
        ptr = np.searchsorted(owner, np.arange(len(self.docs)))
        starts = np.empty_like(ends)
        starts[1:] = ends[:-1]
        first = ptr[:-1][np.diff(ptr) > 0]
        starts[first] = self.docs[:-1][np.diff(ptr) > 0]
        return starts, ends, ptr


def words(texts: pa.Array, separators: np.ndarray = SPACES) -> Words:
    data, docs = buffers(texts)
    starts, ends = [], []
    d, n = 0, len(docs) - 1
    while d < n:  # whole documents, about _STEP bytes at a time
        e = max(d + 1, int(np.searchsorted(docs, docs[d] + _STEP, "right")) - 1)
        lo, hi = docs[d], docs[e]
        if hi > lo:
            gap = separators[data[lo:hi]]
            inner = docs[d:e] - lo
            inner = inner[inner < hi - lo]
            before = np.empty_like(gap)
            before[1:] = gap[:-1]
            before[inner] = True
            after = np.empty_like(gap)
            after[:-1] = gap[1:]
            after[-1] = True
            after[inner[inner > 0] - 1] = True
            starts.append(np.flatnonzero(~gap & before) + lo)
            ends.append(np.flatnonzero(~gap & after) + (lo + 1))
        d = e
    none = np.zeros(0, np.int64)
    starts, ends = np.concatenate([none, *starts]), np.concatenate([none, *ends])
    return Words(data, docs, starts, ends, np.searchsorted(starts, docs))


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span data[start:end], from eight bytes at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    left = ends - starts
    out = mix(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    which, at = None, starts
    while len(at):
        taken = np.minimum(left, 8)
        piece = mix((out if which is None else out[which]) * np.uint64(0xD6E8FEB86659FD93) + (eights[at] & _KEEP[taken]))
        more = left > 8
        if which is None:
            out, which = piece, np.flatnonzero(more)
        else:
            out[which], which = piece, which[more]
        at, left = at[more] + 8, left[more] - 8
    return out


def window_hashes(h: np.ndarray, width: int, base: int = 0xA24BAED4963EE407) -> np.ndarray:
    """A 64-bit hash of every run of width consecutive word hashes (runs may cross documents; callers mask those)."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    if width <= 8:
        p = powers(base, width)
        for k in range(width):
            out += h[k : k + n] * p[k]
        return mix(out)
    inverse = pow(base, -1, 1 << 64)
    step = 1 << 20
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        part = h[lo : hi + width - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers(base, len(part)), out=sums[1:])
        out[lo:hi] = (sums[width:] - sums[:-width]) * powers(inverse, hi - lo)
    return mix(out)


def within(ptr: np.ndarray, width: int) -> np.ndarray:
    """Positions at which a run of width words stays inside its document."""
    counts = np.maximum(np.diff(ptr) - width + 1, 0)
    return ragged_range(ptr[:-1], counts)


def ragged_range(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, for every i."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - first, counts)


def ragged_take(values: np.ndarray, ptr: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows which of a ragged array, one after another, and the length of each."""
    counts = (ptr[1:] - ptr[:-1])[which]
    return values[ragged_range(ptr[:-1][which], counts)], counts


def binary_array(data: np.ndarray, ptr: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(ptr) - 1, [None, pa.py_buffer(np.ascontiguousarray(ptr, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def groups(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
