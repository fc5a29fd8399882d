"""What a Python worker remembers between batches.

Workers are reused from stage to stage, so a worker that kept what every operator before had cached
would grow with the number of stages. A task names the cache it is going to use; all others go.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

_KEPT: dict[str, object] = {}


def only(name: str, make: Callable[[], object]) -> object:
    """The cache of that name, made where there is none; those of other names are dropped."""
    others = [k for k in _KEPT if k != name]
    for k in others:
        del _KEPT[k]
    if others:
        try:  # hand the freed memory back
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]
