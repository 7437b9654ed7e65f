"""Arrow list columns <-> NumPy matrices, for the batch kernels.

A batch may mix elements of different order (different cases in one table), so
rows are processed per array length; NULL rows give NULL.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def flat(arr: pa.Array) -> np.ndarray:
    """The concatenated values of a list column as float64."""
    return arr.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)


def lengths(arr: pa.Array) -> np.ndarray:
    """List length per row, -1 for NULL."""
    return pc.fill_null(pc.list_value_length(arr), -1).to_numpy(zero_copy_only=False)


def to_list(mat: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column."""
    rows, width = mat.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * np.int32(width))
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(mat, dtype=float).ravel()))


def side_of(length: int) -> int:
    n = int(round(length ** 0.5))
    if n * n != length:
        raise ValueError(f"an element array has {length} values, not a square number")
    return n


def row_groups(columns: list[pa.Array]):
    """Yield ``(row indices or None, [matrix, ...])`` per array length.

    Indices are ``None`` when one group covers the whole batch.
    """
    size = np.stack([lengths(c) for c in columns])
    same = (size == size[0]).all(axis=0) & (size[0] >= 0)
    if same.all() and len(np.unique(size[0])) == 1:
        yield None, [flat(c).reshape(len(c), -1) for c in columns]
        return
    if (~same & (size >= 0).all(axis=0)).any():
        raise ValueError("the arrays of an element have different lengths")
    for width in np.unique(size[0][same]):
        idx = np.nonzero(same & (size[0] == width))[0]
        yield idx, [flat(c.take(pa.array(idx))).reshape(len(idx), width) for c in columns]


def map_matrices(fn, columns: list[pa.Array], value_type: pa.DataType) -> pa.Array:
    """Apply ``fn(*matrices, rows) -> Arrow array`` group by group, restoring row order.

    ``rows`` are the batch positions of the group (for scalar side inputs).
    """
    total = len(columns[0])
    parts, where = [], np.full(total, -1, dtype=np.int64)
    base = 0
    for idx, mats in row_groups(columns):
        rows = np.arange(total) if idx is None else idx
        out = fn(*mats, rows)
        if idx is None:
            return out
        parts.append(out)
        where[rows] = base + np.arange(len(rows))
        base += len(rows)
    if not parts:
        return pa.nulls(total, value_type)
    return pa.concat_arrays(parts).take(pa.array(where, mask=where < 0))
