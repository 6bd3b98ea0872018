"""What Python workers keep between tasks: they live on for later stages, in the memory that an executor has for all of them."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa

from . import tokens

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def release() -> None:
    """Memory that this worker has freed goes back to the system; else it stays with the worker's allocators."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run: Run, tokenizes: bool = False) -> Run:
    """``run`` for ``mapInArrow``, which leaves no freed memory behind; tokenizers of earlier stages go first, unless it ``tokenizes``."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not tokenizes:
            tokens.forget()
        try:
            yield from run(batches)
        finally:
            release()

    return tidied
