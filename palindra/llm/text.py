"""Vectorised word and shingle kernels over Arrow string columns (no Spark imports).

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Word identity is exact: Arrow's
dictionary encoding compares the bytes. Shingles are named by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 4 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """Words of a block of texts: ``codes[first[d]:first[d+1]]`` index ``vocabulary`` for text d."""

    codes: np.ndarray
    first: np.ndarray
    vocabulary: pa.Array
    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def texts(self) -> np.ndarray:
        """The text number of every word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def blocks(batches, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into slices whose ``column`` holds about ``limit`` bytes at most.

    A single row larger than the limit forms a slice of its own.
    """
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) if batch.num_rows else []
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, nulls as empty values."""
    texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else "") if texts.null_count else texts
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    bufs = texts.buffers()
    offsets = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8)[offsets[0] : offsets[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def space(data: np.ndarray) -> np.ndarray:
    """Which bytes are 0x20 or 0x09-0x0D."""
    return (data == 0x20) | (data - np.uint8(0x09) < 5)


def runs(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs where ``inside`` holds, never across two texts.

    ``cut[i]`` also parts byte i from byte i+1.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    parted = np.zeros(len(data) + 1, bool)
    parted[offsets] = True
    if cut is not None:
        parted[1:-1] |= cut[: len(data) - 1]
    starts, ends = parted[:-1].copy(), parted[1:]
    starts[1:] |= ~inside[:-1]
    ends[:-1] |= ~inside[1:]
    return np.flatnonzero(inside & starts), np.flatnonzero(inside & ends) + 1


def strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The slices as a string array; what lies between two slices must be whole characters."""
    n = len(starts)
    at = np.zeros(2 * n + 1, np.int32)
    at[1::2], at[2::2] = starts, ends
    both = pa.StringArray.from_buffers(2 * n, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data)))
    return both.take(pa.array(np.arange(1, 2 * n, 2)))


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Split every text; ``lower`` folds A-Z only. Null counts as empty."""
    data, offsets = flat(texts)
    data = _LOWER[data] if lower else data
    starts, ends = runs(data, offsets, ~space(data))
    coded = strings(data, starts, ends).dictionary_encode() if len(starts) else pa.array([], pa.string()).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return Words(codes, np.searchsorted(starts, offsets).astype(np.int64), coded.dictionary, starts, ends, offsets, data)


def name64(values: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string, equal in every process."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(x) for x in values.to_pylist()), np.uint64, len(values))


#: Masks of the first 0 to 8 bytes of a little-endian word.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_LONG = 64


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice of the bytes, equal in every process: eight bytes of all slices are mixed in at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    size = ends - starts
    out = mix((eight[starts] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rest = np.flatnonzero(size > 8)
    for low in range(8, _LONG, 8):
        if not len(rest):
            return out
        left = size[rest] - low
        out[rest] = mix((out[rest] ^ (eight[starts[rest] + low] & _MASK[np.minimum(left, 8)])) + np.uint64(low))
        rest = rest[left > 8]
    for k in rest:
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_constants(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit multipliers."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64 - 1, n, np.uint64) | np.uint64(1)


def shingles(w: Words, size: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the ``size``-word shingles of every text, repeats included.

    A text with 1 to size-1 words has its whole word sequence as its one shingle; a text without
    words has none.
    """
    h = (name64(w.vocabulary) if hashes is None else hashes)[w.codes] if len(w.codes) else np.zeros(0, np.uint64)
    counts, c = w.counts, odd_constants(size, 5)
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    total = np.zeros(len(h), np.uint64)
    owner_end = np.repeat(w.first[1:], counts)
    place = np.arange(len(h))
    short = counts < size
    for k in range(size):
        part = padded[k : k + len(h)] * c[k]
        # words past the text's end only occur in short texts: they add nothing there
        total += np.where(place + k < owner_end, part, np.uint64(0)) if short.any() else part
    total = mix(total + np.uint64(0x9E3779B97F4A7C15))
    made = np.where(short, np.minimum(counts, 1), counts - size + 1)
    first = np.concatenate([[0], np.cumsum(made)])
    take = np.repeat(w.first[:-1] - first[:-1], made) + np.arange(first[-1])
    return total[take], first
