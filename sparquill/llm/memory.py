"""Memory of worker processes that go from one operator's tasks to the next one's."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def release() -> None:
    """Gives freed memory, which allocators keep for later, back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task, with freed memory given back before and after."""

    def of(batches: Iterator) -> Iterator:
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return of
