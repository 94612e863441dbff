"""One value a partition, merged along a tree of tasks, so that the driver meets only the last few."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .memory import lean

#: Beyond so many partitions the tree gets a third level.
_FLAT = 1024


def reduced(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], bytes], merge: Callable, read: Callable[[bytes], object]):
    """``merge`` over what ``read`` makes of ``part`` of every partition; None for a table without partitions."""

    def one(batches) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([part(batches)], pa.binary())], names=["part"])

    parts = rows.mapInArrow(lean(one), "part binary").rdd.map(lambda r: read(bytes(r.part)))
    n = parts.getNumPartitions()
    return parts.treeReduce(merge, 2 if n <= _FLAT else 3) if n else None
