"""What a Python worker keeps between tasks, one operator's at a time.

Spark hands a worker from stage to stage. What it has learned is worth keeping for the next
task of the same operator, but the operators' caches together would be more than an
executor has room for, so an operator's task first drops those of the others.
"""

from __future__ import annotations

import gc
from collections.abc import Callable

_KEPT: dict[str, Callable[[], None]] = {}
_last = ""


def keeps(operator: str, forget: Callable[[], None]) -> None:
    """Say how to drop what the operator keeps."""
    _KEPT[operator] = forget


def enter(operator: str) -> None:
    """Called where a task of the operator begins."""
    global _last  # noqa: PLW0603
    if operator == _last:
        return
    for name, forget in _KEPT.items():
        if name != operator:
            forget()
    if _last:
        import pyarrow as pa

        gc.collect()
        pa.default_memory_pool().release_unused()
    _last = operator


def give_back() -> None:
    """Called where a task ends that leaves much memory free: an idle worker would hold on to it while stages without Python run."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
