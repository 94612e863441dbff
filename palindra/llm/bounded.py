"""Tables of a fixed size, gathered from all rows: hashed counts and Bloom filters.

Tasks fill a table of their own and emit it in chunks; Spark brings equal chunks together and they
are combined one by one. Only a table of the fixed size reaches the driver and is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text
from .memory import lean

COUNT_BITS = 20
BLOOM_BITS = 26
_CHUNK = 1 << 12


def gather(rows: DataFrame, fill: Callable[[np.ndarray, pa.RecordBatch], None], size: int, dtype, combine: np.ufunc) -> np.ndarray:
    """The table of ``size`` entries that ``fill`` makes of all rows, combined by ``combine``."""

    def local(batches) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size, dtype)
        for batch in batches:
            fill(table, batch)
        parts = table.reshape(-1, min(_CHUNK, size))
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([parts[k].tobytes() for k in used], pa.binary())], names=["chunk", "part"])

    def merge(batches) -> Iterator[pa.RecordBatch]:
        chunk, total = None, None
        for batch in batches:
            done: list[tuple[int, bytes]] = []
            for k, part in zip(batch.column("chunk").to_pylist(), batch.column("part")):
                values = np.frombuffer(part.as_buffer(), dtype)
                if k != chunk:
                    if chunk is not None:
                        done.append((chunk, total.tobytes()))
                    chunk, total = k, values.copy()
                else:
                    combine(total, values, out=total)
            if done:
                yield _chunks(done)
        if chunk is not None:
            yield _chunks([(chunk, total.tobytes())])

    parts = rows.mapInArrow(lean(local), "chunk long, part binary").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(lean(merge), "chunk long, part binary")
    out = np.zeros(size, dtype).reshape(-1, min(_CHUNK, size))
    for row in parts.toLocalIterator():
        out[row.chunk] = np.frombuffer(row.part, dtype)
    return out.ravel()


def _chunks(done: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.int64()), pa.array([p for _, p in done], pa.binary())], names=["chunk", "part"])


def count_slots(hashes: np.ndarray, bits: int = COUNT_BITS) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _bits(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    mixed, mask = text.mix(hashes), np.uint64((1 << bits) - 1)
    step = (mixed >> np.uint64(32)) | np.uint64(1)
    return [(mixed + np.uint64(k) * step) & mask for k in range(4)]


def bloom(rows: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], bits: int = BLOOM_BITS) -> np.ndarray:
    """A Bloom filter of ``2**bits`` bits over the hashes of all rows; a full one passes everything."""

    def fill(table: np.ndarray, batch: pa.RecordBatch) -> None:
        for spot in _bits(hashes(batch), bits):
            np.bitwise_or.at(table, (spot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spot & np.uint64(63)))

    # one table a slot of the cluster, not one a shuffle partition
    rows = rows.coalesce(max(1, rows.sparkSession.sparkContext.defaultParallelism))
    return gather(rows, fill, 1 << (bits - 6), np.uint64, np.bitwise_or)


def passes(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter."""
    out = np.ones(len(hashes), bool)
    for spot in _bits(hashes, int(np.log2(len(table) * 64))):
        out &= (table[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) > 0
    return out


def split(rows: DataFrame, column: str, keys: DataFrame) -> tuple[DataFrame, Callable[[Callable, object], DataFrame]]:
    """(rows whose integer ``column`` may be in ``keys``, a function that maps the rows that are surely not).

    What is surely absent needs no join, so its other columns are not shuffled: the function takes
    what mapInArrow takes and applies it in the same pass that leaves the others out. Nulls are absent.
    """
    name = keys.columns[0]
    value = lambda c: c.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    table = rows.sparkSession.sparkContext.broadcast(bloom(keys.select(name), lambda b: value(b.column(name))))

    def part(wanted: bool, batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = b.column(column)
            some = c.is_valid().to_numpy(zero_copy_only=False)
            hit = np.zeros(len(some), bool)
            hit[some] = passes(table.value, value(c.drop_null()))
            yield b.filter(pa.array(hit == wanted))

    touched = rows.mapInArrow(lean(lambda batches: part(True, batches)), rows.schema)
    return touched, lambda f, schema: rows.mapInArrow(lean(lambda batches: f(part(False, batches))), schema)
