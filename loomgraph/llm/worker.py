"""What a Python worker holds between tasks.

A worker outlives its tasks, and on an executor whose memory is bounded what one stage built is in the next one's
way. Things made for a stage are therefore dropped by the first task of another stage, and memory that a task has
freed is given back to the system, which allocators otherwise keep.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark import TaskContext

_made: dict[Any, Any] = {}
_stage: int | None = None


def _now() -> int | None:
    task = TaskContext.get()
    return task.stageId() if task else None


def kept(name: Any, make: Callable[[], Any]) -> Any:
    """What make() gives, made once for each worker and stage."""
    global _stage
    if _stage != _now():
        _made.clear()
        _stage = _now()
    if name not in _made:
        _made[name] = make()
    return _made[name]


def _trim() -> None:
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library; it manages without
        pass


def give_back() -> None:
    """Drop what earlier stages made and return freed memory."""
    if _stage != _now():
        _made.clear()
    pa.default_memory_pool().release_unused()
    _trim()


def tidy(run: Callable) -> Callable:
    """run, a function of a task's batches, with give_back() before and after it."""

    def tidied(batches):
        give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied
