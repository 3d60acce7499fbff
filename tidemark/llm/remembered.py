"""What a Python worker remembers from task to task; it serves one operator at a time.

Workers are used again for tasks of later operators, in which what an earlier one remembered would only
take room that the executor's other tasks need.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable

import pyarrow as pa

_held: dict[Hashable, object] = {}


def forget() -> None:
    """Drop everything that is remembered and give its pages back to the system."""
    if not _held:
        return
    _held.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def remembered(key: Hashable, make: Callable[[], object]):
    """What is remembered as ``key``, made anew if that is not what the worker remembers now."""
    if key not in _held:
        forget()
        _held[key] = make()
    return _held[key]
