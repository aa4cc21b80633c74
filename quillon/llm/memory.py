"""What a Python worker remembers: one model, and results up to a number of bytes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable

import pyarrow as pa

#: Bytes of an entry besides its letters: its place in the table, and two objects.
ENTRY = 200


class Recent:
    """Results (bytes) of a function of lists of texts. Of those beyond `most` bytes, the ones asked for lately stay; what
    belongs to a text of more than `longest` letters is not remembered."""

    def __init__(self, function: Callable[[list[str]], list[bytes]], most: int, longest: int = 64) -> None:
        self.function, self.half, self.longest = function, most // 2, longest
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bytes = 0

    def of(self, keys: Iterable[str]) -> dict[str, bytes]:
        """The result of each key."""
        found, missing = {}, []
        for key in keys:
            if (value := self.newer.get(key)) is None:
                if (value := self.older.get(key)) is None:
                    missing.append(key)
                    continue
                self._remember(key, value)
            found[key] = value
        values = self.function(missing)
        found |= zip(missing, values, strict=True)
        for key, value in zip(missing, values, strict=True):
            if len(key) <= self.longest:
                self._remember(key, value)
        return found

    def _remember(self, key: str, value: bytes) -> None:
        size = ENTRY + len(key) + len(value)
        if self.bytes + size > self.half:
            self.newer, self.older, self.bytes = {}, self.newer, 0
        self.bytes += size
        self.newer[key] = value


_HELD: dict[object, object] = {}
_SETTLED: list[bool] = []
#: Numbers of the C library's options: bytes from which a block is mapped by itself, and free bytes that are given back.
MAPPED, TRIMMED = (-3, 1 << 18), (-1, 1 << 20)


def settle() -> None:
    """Let the worker give freed arrays and Arrow batches back to the system at once, where the C library can do so; by
    itself it keeps them, and a worker that goes from stage to stage only grows."""
    if _SETTLED:
        return
    _SETTLED.append(True)
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        for option in (MAPPED, TRIMMED):
            ctypes.CDLL(None).mallopt(*option)
    except (AttributeError, OSError):
        pass


def held(key: object, make: Callable[[], object]) -> object:
    """The model of a key, kept for later tasks of the worker until another one is asked for."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """At the start of tasks that need no model: let go of that of an earlier stage."""
    settle()
    if _HELD:
        _HELD.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass
