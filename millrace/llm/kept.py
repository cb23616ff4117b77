"""What a Python worker keeps from one task to the next: of one operator at a time.

A worker outlives the operators whose tasks it runs, so without this it would hold the
memos and indexes of all stages of a pipeline at once.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa

_kept: dict = {}


def kept(key: Hashable, make: Callable):
    """What make() gave when this key was last asked for; what was kept by another key is dropped before make() runs."""
    if key not in _kept:
        _kept.clear()
        gc.collect()  # a tokenizer and its memos refer to each other
        _kept[key] = make()
    return _kept[key]


def trim() -> None:
    """Give freed memory back to the system, which Arrow's pool and the allocator of glibc else hold."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task for mapInArrow that trims at its end, so that an idle worker doesn't hold batches while other stages run."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return task
