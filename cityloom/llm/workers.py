"""What a Python worker keeps between tasks.

Workers are reused by whatever runs next, so a worker holds the tables and
caches of one operator at a time and gives their memory back before it takes up
another's.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable
from typing import TypeVar

T = TypeVar("T")
_held: dict[Hashable, object] = {}


def held(kind: Hashable, make: Callable[[], T]) -> T:
    """The worker's object of this kind; objects of other kinds are dropped when it is made."""
    if kind not in _held:
        if _held:
            _held.clear()
            trim()
        _held[kind] = make()
    return _held[kind]  # type: ignore[return-value]


def trim() -> None:
    """Return freed memory to the system, where the C library can."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass
