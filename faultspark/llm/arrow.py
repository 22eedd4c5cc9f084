"""Helpers for functions that run on executors."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def tidy(keep: str = "") -> None:
    """Give memory that a task has freed back to the system.

    Python workers serve many tasks, of one operator after the other; caches of
    operators other than the one to ``keep`` are dropped."""
    for name in [n for n in vars(sys) if n.startswith("_faultspark_") and n != keep]:
        delattr(sys, name)
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of an Arrow string column, row by row; null is empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def gather(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that start at ``begins``, one after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.arange(total) + np.repeat(begins - (ends - sizes), sizes)]
