"""Memory of long-lived Python processes: the driver's and the workers'."""

from __future__ import annotations

import ctypes

import pyarrow as pa


def give_back() -> None:
    """Return freed memory to the system; else a process keeps what its largest step took, as long as it lives."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # only glibc has it
        pass
