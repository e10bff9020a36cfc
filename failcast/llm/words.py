"""Words of Arrow string columns as numpy arrays: places, row numbers and 64-bit hashes.

A word is a run of bytes outside a set of separator bytes, so no Python string is
made for it. Callers get texts in blocks of bounded size (``blocks``), a longer
text alone in a block of its own.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 19

_M = np.uint64(0x9E3779B97F4A7C15)


def return_memory(small: bool = False) -> None:
    """Let this worker give freed arrays of 1 MB or more back to the machine at once (glibc; elsewhere nothing
    happens), so that idle workers of other stages hold little. ``small``: what is free of smaller ones now, too."""
    mallopt = getattr(ctypes.CDLL(None), "mallopt", None)
    if mallopt:
        mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
    pa.default_memory_pool().release_unused()
    if small and mallopt:
        ctypes.CDLL(None).malloc_trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = np.array(x, dtype=np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_MULT = np.uint64(0xD1342543DE82EF95)
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 256


#: The separators ``[\x20\x09-\x0D]``: everything else is part of a word.
WORD_BYTES = np.ones(256, dtype=bool)
WORD_BYTES[[0x20, *range(0x09, 0x0E)]] = False
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text with A-Z lowered.
ALNUM_BYTES = np.zeros(256, dtype=bool)
ALNUM_BYTES[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


@dataclass
class Words:
    data: np.ndarray     # bytes of the block (lowered if asked)
    offsets: np.ndarray  # n_rows + 1: where each row's bytes begin
    start: np.ndarray    # first byte of each word
    end: np.ndarray      # one past its last byte
    row: np.ndarray      # row of each word, ascending
    first: np.ndarray    # n_rows + 1: index of each row's first word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes, which pass a finaliser eight at a time.

        Words of up to eight bytes differ in their hashes wherever they differ at the same length; of longer ones, two
        differently mixed states must both meet. Words of over ``LONG_WORD`` bytes take BLAKE2b."""
        size = self.end - self.start
        body = np.zeros(len(self.data) + 8, dtype=np.uint8)
        body[: len(self.data)] = self.data
        eight = np.ndarray(len(self.data) + 1, "<u8", body, strides=(1,))  # the eight bytes from each place on

        def bytes_at(who: np.ndarray | slice, done: int) -> np.ndarray:
            spare = (np.maximum(8 - (size[who] - done), 0) * 8).astype(np.uint64)
            return (eight[self.start[who] + done] << spare) >> spare

        out = size.astype(np.uint64) * _M
        one = bytes_at(slice(None), 0)
        out = mix(out ^ one)
        who, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
        many, a, b = who, out[who], one[who] * _MULT
        place = np.arange(len(who))
        while len(place):
            now = bytes_at(many[place], done)
            a[place] = mix(a[place] ^ now)
            b[place] = (b[place] ^ (b[place] >> np.uint64(29))) * _MULT + now
            done += 8
            place = place[size[many[place]] > done]
        out[many] = mix(a + mix(b))
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.data[self.start[i]: self.end[i]].tobytes(), digest_size=8).digest(), "little")
        return out

    def texts(self) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start.tolist(), self.end.tolist())]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    body = column.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8)[offsets[0]: offsets[-1]] if body else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray, part: np.ndarray = WORD_BYTES, lower: bool = False) -> Words:
    """Words of each row; a word never crosses rows."""
    if lower:
        data = LOWER[data]
    n = len(data)
    inside = part[data]
    begins, ends = inside.copy(), inside.copy()
    if n:
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = offsets[(offsets > 0) & (offsets < n)]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, start, end, row, first)


def word_bytes(w: Words) -> pa.Array:
    """The words of a block behind one another, as one binary array."""
    edge = np.zeros(len(w.data) + 1, np.int8)
    edge[w.start] += 1
    edge[w.end] -= 1  # of words that meet at a row's edge, both cancel out
    body = w.data[np.cumsum(edge[:-1], dtype=np.int8).astype(bool)]
    places = np.append(0, np.cumsum(w.end - w.start))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(body.tobytes())])


def blocks(batch: pa.RecordBatch, column: str = "text", size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about ``size`` bytes of text each: (rows, bytes, offsets)."""
    data, offsets = text_bytes(batch.column(column))
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at]: offsets[to]], offsets[at: to + 1] - offsets[at]
        at = to


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words inside one row, and the index of each run's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        total = (total ^ (total >> np.uint64(29))) * _MULT + hashes[j: j + n]
    whole = np.ones(n, dtype=bool)
    for edge in np.unique(first[1:-1]):  # runs over a row's edge
        whole[max(0, edge - k + 1): edge] = False
    at = np.flatnonzero(whole)
    return mix(total[at]), at
