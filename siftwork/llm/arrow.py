"""Helpers for functions that run on Arrow batches in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def free_name(columns: list[str], name: str) -> str:
    """A column name that is not taken."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def sliced(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `limit` bytes in `column`, or one row."""
    col = batch.column(column)
    n = batch.num_rows
    if not n:
        return
    sizes = np.diff(offsets_of(col))
    at = 0
    total = np.cumsum(sizes)
    while at < n:
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
        yield batch.slice(at, end - at)
        at = end


def offsets_of(col: pa.Array) -> np.ndarray:
    """Byte offsets of a string or binary array, absolute in its data buffer."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    raw = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)
    return raw[col.offset : col.offset + len(col) + 1].astype(np.int64)


def texts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values together and the offsets of each; null values are empty."""
    off = offsets_of(col)
    if col.null_count:
        keep = ~np.asarray(col.is_null())
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
        off = offsets_of(col)
        assert (np.diff(off)[~keep] == 0).all()
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def raw_values(col: pa.Array) -> list[bytes]:
    """Values as bytes without decoding; null values are empty."""
    data, off = texts(col)
    view = data.tobytes()
    return [view[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
