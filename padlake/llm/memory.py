"""Giving back memory: Python workers live on between tasks, and what one task has freed would count against the next."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa

try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library: it has its own ways
    _trim = None


def trim() -> None:
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def trimmed(f: Callable) -> Callable:
    """``f`` of a group's key and its table or two, after which freed memory goes back to the system."""

    def one(key, table):
        try:
            return f(key, table)
        finally:
            trim()

    def two(key, left, right):
        try:
            return f(key, left, right)
        finally:
            trim()

    return two if f.__code__.co_argcount == 3 else one
