"""A bounded memory of what was made for each distinct piece of text.

Texts are sequences of pieces that repeat, so a worker makes each result once and
then looks it up.  Two generations bound the memory: when the young one is full it
becomes the old one, within a text as well as between texts, and pieces still in use
move back.  The result never depends on what is remembered.
"""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable

import pyarrow as pa


class Remembered(dict):
    def __init__(self, make: Callable[[str], object], size: int = 250_000, longest: int = 64):
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, piece: str):
        found = self.old.get(piece)
        if found is None:
            found = self.make(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[piece] = found
        return found


#: What a worker holds for further tasks of one operator: the function and arguments that made it, and the result.
_held: list = [None, None]


def forget() -> None:
    """Drop what tasks of another operator left in this worker."""
    _held[:] = [None, None]


def held_by_worker(make: Callable) -> Callable:
    """Keep the last result from task to task; a worker holds one for all functions so marked."""

    @functools.wraps(make)
    def get(*args):
        if _held[0] != (make, args):
            forget()
            _held[:] = [(make, args), make(*args)]
        return _held[1]

    return get


def give_back() -> None:
    """Return what a task has freed to the system, as workers stay for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
