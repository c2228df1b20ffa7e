"""Payloads of a batch as a (row, byte) matrix: fields, checksums and bytes are handled a column of bytes at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(payloads: pa.Array, width: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(bytes as a matrix of at least `width` columns, filled with zeros; lengths). Null has no bytes."""
    wide = pa.types.is_large_binary(payloads.type)
    n = len(payloads)
    _, ends, data = payloads.buffers()
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[payloads.offset : payloads.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    length = np.where(np.asarray(payloads.is_null()), 0, np.diff(at))
    width = max(width, int(length.max(initial=0)))
    column = np.arange(width)
    inside = column < length[:, None]
    return np.where(inside, raw[np.minimum(at[:-1, None] + column, len(raw) - 1)], 0).astype(np.uint8), length


def binary(rows: np.ndarray, length: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    """The first `length` bytes of each row as a binary array."""
    inside = np.arange(rows.shape[1]) < length[:, None]
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    mask = None if valid is None else pa.array(valid).buffers()[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [mask, pa.py_buffer(ends), pa.py_buffer(rows[inside].tobytes())])


def put(rows: np.ndarray, length: np.ndarray, runs: list[tuple[int, int, int, int]] | None, raw: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Write raw values (unsigned 64-bit) into the field of `runs` (see bits.runs) where wanted; which rows had room for it."""
    if runs is None:
        return np.zeros(len(rows), bool)
    done = where & (length > max(byte for byte, *_ in runs))
    for byte, low, width, place in runs:
        if byte < rows.shape[1]:
            part = (raw >> np.uint64(place)).astype(np.uint8) & np.uint8((1 << width) - 1)
            own = rows[:, byte] & np.uint8(0xFF & ~(((1 << width) - 1) << low)) | part << np.uint8(low)
            rows[:, byte] = np.where(done, own, rows[:, byte])
    return done


def names_where(names: list[str], where: np.ndarray) -> pa.Array:
    """Of each row of a (row, name) matrix the names that hold."""
    ends = np.concatenate([[0], np.cumsum(where.sum(axis=1))]).astype(np.int32)
    values = np.broadcast_to(np.arange(len(names)), where.shape)[where]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(names, pa.string()).take(pa.array(values, pa.int64())))
