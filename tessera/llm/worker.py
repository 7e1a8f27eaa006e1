"""What a Python worker holds between tasks.

Spark uses workers again for whatever stage comes next. Without this, a worker would add up the vocabularies and models
of all operators that ran in it, and the free pages that the C library keeps after large arrays.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")
_KEPT: dict[Hashable, object] = {}


def kept(key: Hashable, make: Callable[[], T]) -> T:
    """The object of that key, made once for a worker; making one drops that of another key first."""
    if key not in _KEPT:
        drop_kept()
        _KEPT[key] = make()
        give_back()
    return _KEPT[key]


def drop_kept() -> None:
    """For tasks that need none of it: forget what is kept and give its memory back."""
    _KEPT.clear()
    give_back()


def give_back() -> None:
    """Free pages of Arrow's pool and of the C library go back to the system, where the library can do that (glibc)."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
