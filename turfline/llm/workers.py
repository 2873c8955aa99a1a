"""Memory of Python workers, which live on between tasks."""

from __future__ import annotations

import ctypes
import gc


def give_back() -> None:
    """Return freed memory to the system at the end of a task, so that an idle worker holds little; where the C library can't, nothing is done."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
