"""Python workers outlive their tasks: hand the memory of a finished task back to the system.

Spark deals tasks to its idle workers in turn, and a stage of several Arrow passes leaves more workers than cores, so what
one pass keeps between its tasks is soon held by all of them.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

try:  # only the GNU C library has it
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):
    _trim = None


_KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    """The worker's table of that name: it lasts until a pass begins that does not keep it (see :func:`lean`)."""
    return _KEPT.setdefault(name, {})


def forget(keeps: str | None = None) -> None:
    """Empty all kept tables but the one of the name ``keeps``."""
    for name, table in _KEPT.items():
        if name != keeps:
            table.clear()


def release() -> None:
    """Return freed memory to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(run: Callable, keeps: str | None = None) -> Callable:
    """``run`` (batches to batches) that releases what it no longer uses when it ends, and first what earlier passes kept, except in ``keeps``."""

    def wrapped(batches) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
