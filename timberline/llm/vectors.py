"""Columns of vectors as whole numbers, for the operators that have to be exact."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def whole(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which lists of a column take part, their lengths, and floor(256 * x) of their components one after another, as 64-bit floats.

    A list takes no part if it is null, or if it holds a null or a component that is not finite (multiplied or not).
    """
    import pyarrow.compute as pc

    there = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(256 * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))  # a null is not a number
    ends, wrong = np.cumsum(sizes), np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = there & (wrong[ends] == wrong[ends - sizes])
    return good, sizes[good], values[np.repeat(good, sizes)]


def filled(sizes: np.ndarray, values: np.ndarray, dims: int) -> np.ndarray:
    """A matrix of ``dims`` columns from lists of ``sizes``, filled up with zeros."""
    if (sizes == dims).all():
        return values.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = values
    return out
