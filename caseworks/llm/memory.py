"""What a Python worker keeps from one batch, task or operator to the next, within a budget of bytes.

Workers outlive tasks and stages, and meet all operators of a pipeline. One operator's things are kept at a time: the first call for another
owner lets go of all that the last one held. Workers also stay, idle, beside stages that need none: what is made again cheaply goes at the end of
each task (`for_task`), the rest when a worker has had no task for some seconds (`until_idle`). Tables of values seen count the bytes of their
entries and forget what was not asked for lately when their budget is spent; results never depend on what is kept.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import threading
import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa

#: Bytes that one table of values seen may take, and the part of it that one entry may take.
BUDGET, LARGEST_SHARE = 40_000_000, 64
#: Bytes that a dictionary needs for an entry beside the key and the value themselves.
SLOT = 100
#: Seconds without a task after which a worker is idle, and between looks at that.
IDLE_S, LOOK_S = 3.0, 1.0

#: Bytes of the largest array, and of all arrays, that are kept for reuse when they are freed.
MAPPED, KEPT = 16_000_000, 64_000_000

_held: dict[str, Any] = {}
_lock = threading.RLock()
_tasks, _ended, _watching = 0, 0.0, False


def held(owner: str, make: Callable[[], Any]) -> Any:
    """What make() gave for this owner, made anew when another owner has come between."""
    with _lock:
        if owner not in _held:
            _held.clear()
            gc.collect()
            release()
            _held[owner] = make()
        return _held[owner]


def release() -> None:
    """Let go of what is held, and give free memory back to the system."""
    _held.clear()
    pa.default_memory_pool().release_unused()
    trim()


def trim() -> None:
    """Give free memory back to the system."""
    of_library = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has it
    if of_library is not None:
        of_library(0)


def reuse_freed() -> None:
    """Keep freed arrays, of up to MAPPED bytes each and KEPT bytes in all, for the arrays to come, until trim().

    Otherwise arrays of some hundred KB and more go back to the system when they are freed, and it hands over new pages, one by one and
    cleared, for each array: for steps that make many such arrays, a quarter of their time.
    """
    limit = getattr(ctypes.CDLL(None), "mallopt", None)  # of the C library, where it has it
    if limit is not None:
        limit(-3, MAPPED)  # M_MMAP_THRESHOLD
        limit(-1, KEPT)  # M_TRIM_THRESHOLD


def for_task(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which lets go at its end of all that is held."""

    def until_its_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return until_its_end


def _watch() -> None:
    """Let go of all that is held once there has been no task for IDLE_S seconds."""
    global _watching
    while True:
        time.sleep(LOOK_S)
        with _lock:
            if not _tasks and time.monotonic() - _ended >= IDLE_S:
                _watching = False
                gc.collect()
                release()
                return


def until_idle(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which hands on to the next task what is held, unless none comes for IDLE_S seconds."""

    def watched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter()
        try:
            yield from run(batches)
        finally:
            leave()

    return watched


def enter() -> None:
    """A task begins; one thread a process watches for the time after it."""
    global _tasks, _watching
    with _lock:
        _tasks += 1
        if not _watching:
            _watching = True
            threading.Thread(target=_watch, daemon=True).start()


def leave() -> None:
    global _tasks, _ended
    with _lock:
        _tasks, _ended = _tasks - 1, time.monotonic()


class Memo(dict):
    """Values by key, made when first asked for; at most `budget` bytes of them are kept, and none that takes a large part of it.

    Entries are in two halves: when the newer one is full it becomes the older one, and what the older one held, and nobody asked for since, goes.
    """

    def __init__(self, make: Callable[[Any], Any], budget: int = BUDGET):
        super().__init__()
        self.make, self.budget, self.spent = make, budget, 0
        self.older: dict[Any, Any] = {}

    def __missing__(self, key: Any) -> Any:
        value = self.older.pop(key, self)  # itself: not there
        if value is self:
            value = self.make(key)
        size = SLOT + sys.getsizeof(key) + sys.getsizeof(value)
        if size * LARGEST_SHARE <= self.budget:
            if self.spent + size > self.budget // 2:
                self.older = dict(self)
                self.clear()
                self.spent = 0
            self.spent += size
            self[key] = value
        return value
