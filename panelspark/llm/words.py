"""Vectorised word splitting and 64-bit word hashing over Arrow text columns.

A text is lower-cased for A-Z only and cut at separator bytes. Every word gets a 64-bit multilinear hash (a seeded
random weight per byte position, then a bijective mix), so that tasks can count and compare words as integers.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: Bytes that are split and hashed at once; arrays of eight bytes a byte of text stay in cache-friendly sizes.
CHUNK_BYTES = 1 << 20


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the Python worker gives the memory that it no longer needs back to the machine: workers outlive their tasks."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
            ctypes.CDLL(None).malloc_trim(0)

    return released


def table(separators: list[range]) -> np.ndarray:
    """Byte map: separators become 0, A-Z become a-z, all else stays."""
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    for r in separators:
        out[list(r)] = 0
    return out


#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
SPACED = table([range(0x20, 0x21), range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _weights(n: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=_U)) * _U(0x9E3779B97F4A7C15)) | _U(1)


_position_weights = _weights(256)


def bounds(mapped: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of non-zero bytes, none of which goes on from one text to the next."""
    inside = mapped != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    firsts, lasts = offsets[:-1], offsets[1:] - 1
    full = lasts >= firsts
    begins[firsts[full]] = inside[firsts[full]]
    ends[lasts[full]] = inside[lasts[full]]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1 - starts


def hashes(mapped: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hashes of words that together are all the non-zero bytes, in their order."""
    global _position_weights
    if not len(lengths):
        return np.zeros(0, _U)
    longest = int(lengths.max())
    if longest > len(_position_weights):
        _position_weights = _weights(2 * longest)
    at = np.cumsum(lengths) - lengths
    place = np.arange(int(at[-1] + lengths[-1])) - np.repeat(at, lengths)
    sums = np.add.reduceat((mapped[mapped != 0].astype(_U) + _U(1)) * _position_weights[place], at)
    return mix(sums + lengths.astype(_U) * _U(0xD6E8FEB86659FD93))


def split(data: np.ndarray, offsets: np.ndarray, byte_map: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that lie one after the other in data; text i is data[offsets[i]:offsets[i + 1]].

    Returns each word's start and length in data, its hash, and for each text the number of words before it (one entry
    more than texts).
    """
    mapped = byte_map[data]
    starts, lengths = bounds(mapped, offsets)
    return starts, lengths, hashes(mapped, lengths), np.searchsorted(starts, offsets)


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, row after the last, bytes and offsets of about CHUNK_BYTES of a text column; a null is an empty text.

    A single row longer than that is a piece of its own.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    n = len(texts)
    _, offsets_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offsets_buffer, np.int64, n + 1, texts.offset * 8) if offsets_buffer else np.zeros(n + 1, np.int64)
    data = np.frombuffer(data_buffer, np.uint8) if data_buffer else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1)
        own = offsets[row : stop + 1]
        yield row, stop, data[own[0] : own[-1]], own - own[0]
        row = stop


def chunks(texts: pa.Array, byte_map: np.ndarray = SPACED) -> Iterator[tuple]:
    """For each of the pieces of a text column: first row, row after the last, bytes, and what split returns."""
    for row, stop, data, offsets in pieces(texts):
        yield (row, stop, data, *split(data, offsets, byte_map))


def pairs(hashes: np.ndarray) -> np.ndarray:
    """Hashes of each word with the next one."""
    return mix(hashes[:-1] * _U(0x9E3779B97F4A7C15) + hashes[1:])
