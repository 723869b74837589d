"""Small helpers shared by the operators that run in Arrow batches."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20


def loaded() -> dict:
    """What this worker process keeps between tasks: vocabularies, frozen models, piece caches."""
    return sys.__dict__.setdefault("_normtrace_loaded", {})


def text_slices(keys: pa.Array, texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts of an Arrow batch as lists, so many at a time as make ``limit`` bytes, or one.

    Null texts come out as empty ones.
    """
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield keys[first:last].to_pylist(), [t or "" for t in texts[first:last].to_pylist()]
        first = last


def struct_array(types: dict[str, pa.DataType], rows: list[tuple]) -> pa.StructArray:
    """An Arrow array of structs."""
    return pa.StructArray.from_arrays(record_batch(types, rows).columns, list(types))


def record_batch(types: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    """An Arrow batch of rows."""
    columns = list(zip(*rows)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types.values())], list(types))
