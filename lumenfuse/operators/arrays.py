"""Image rows in Arrow batches as NumPy arrays and back, without Python lists."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def lists(column: pa.Array) -> list[np.ndarray]:
    """Values of each row of a list column."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [values[a:z] for a, z in zip(ends[:-1].tolist(), ends[1:].tolist())]


def images(batch: pa.RecordBatch, *channels: str) -> Iterator[list[np.ndarray]]:
    """The channels of each row (h, w, channels...) as (h, w) matrices of doubles."""
    column = lambda c: batch.column(batch.schema.get_field_index(c))
    shapes = zip(column("h").to_pylist(), column("w").to_pylist())
    for shape, *values in zip(shapes, *(lists(column(c)) for c in channels)):
        yield [v.astype(float).reshape(shape) for v in values]


def list_column(arrays: Sequence[np.ndarray]) -> pa.Array:
    """A list column of doubles, one array (of any shape) a row."""
    ends = np.concatenate(([0], np.cumsum([a.size for a in arrays]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([a.ravel() for a in arrays]).astype(float) if len(arrays) else np.empty(0)))
