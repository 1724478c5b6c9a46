"""Arrays in binary columns: many small records travel as one value, without a row for each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def binary_column(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Row i holds the bytes of values[ends[i]:ends[i + 1]]."""
    if not len(ends):
        return pa.array([], pa.binary())
    raw = np.ascontiguousarray(values)
    offsets = (np.asarray(ends, np.int64) * values.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())])


def flat_binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows (null: none), one after another, and the number of bytes of each row."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    wide = pa.types.is_large_binary(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return raw, np.diff(offs)


def pack_columns(columns: dict[str, np.ndarray], start: int, end: int) -> bytes:
    """Records start to end, column by column and compressed, behind their number."""
    raw = b"".join(c[start:end].tobytes() for c in columns.values())
    return (end - start).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_columns(packed: bytes, kind: np.dtype) -> dict[str, np.ndarray]:
    n, at, out = int.from_bytes(packed[:8], "little"), 0, {}
    raw = pa.decompress(packed[8:], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True)
    for c in kind.names:
        out[c] = np.frombuffer(raw, kind[c], n, at)
        at += n * kind[c].itemsize
    return out
