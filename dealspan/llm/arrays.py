"""Small helpers on numpy arrays inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    ends = np.cumsum(size)
    if not len(ends):
        return np.empty(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(begin - (ends - size), size)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    new = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.r_[True, new])


def lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The lists of a column of integers, one by one."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        values, at = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        yield from (values[a:b] for a, b in zip(at[:-1], at[1:], strict=True))
