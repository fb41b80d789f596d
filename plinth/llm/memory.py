"""Python workers serve one task after another, and what a task has freed stays with the worker unless it is given back."""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa


def give_back() -> None:
    """Hands freed memory of Arrow and of the C library back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def giving_back(run):
    """``run``, a function over a task's batches, which gives memory back when its batches end."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
