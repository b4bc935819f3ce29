"""What the two vector operators share: which rows count, and a Hilbert curve."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid_vectors(embeddings: DataFrame, *more: Column) -> DataFrame:
    """Rows with an id and a vector of finite components that are not all zero; vector as array<double>."""
    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    return embeddings.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), *more)


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column, all of one length, as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def hilbert_index(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of non-negative integer coordinates below 2**bits (Skilling 2004).

    Works on all rows at once: first the rotations of each level are undone from the top bit down, then the
    coordinates are Gray-decoded and their bits interleaved.
    """
    x = x.astype(np.uint64).copy()
    n = x.shape[1]
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        low = bit - one
        for i in range(n):
            on = (x[:, i] & bit) != 0
            swap = np.where(on, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            if i:
                x[:, i] ^= swap
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, 0, -1):
        bit = one << np.uint64(level)
        flip ^= np.where((x[:, n - 1] & bit) != 0, bit - one, np.uint64(0))
    x ^= flip[:, None]
    out = np.zeros(len(x), np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << one) | ((x[:, i] >> np.uint64(level)) & one)
    return out.astype(np.int64)
