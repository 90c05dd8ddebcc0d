"""Helpers for Arrow batches inside tasks: text buffers, slices of bounded size, id columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel turns into numpy arrays at once; a text longer than this is a slice of its own.
SLICE_BYTES = 2 << 20


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than the texts) and UTF-8 bytes of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(n + 1, np.int64), np.zeros(0, np.uint8)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows with at most ``limit`` bytes of text each, or one longer row."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(n, max(start + 1, end))
        yield start, end
        start = end


def texts_of(offsets: np.ndarray, data: np.ndarray) -> Iterator[bytes]:
    """Every text as bytes, in order."""
    raw = data.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield raw[a:b]


def column_of(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    column = batch.column(batch.schema.get_field_index(name))
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def int_column(batch: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    """An integer column without nulls."""
    return column_of(batch, name).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def binary_rows(column: pa.Array) -> Iterable[bytes]:
    return column.to_pylist()


def release() -> None:
    """Give freed Arrow memory back to the system; Python workers outlive their tasks and share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
