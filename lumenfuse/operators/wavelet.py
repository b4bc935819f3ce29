"""Multi-level Daubechies wavelets of image rows, and fusion by them (half-sample symmetric border)."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lumenfuse.operators import arrays


@functools.cache
def daubechies(order: int) -> np.ndarray:
    """The 2 * order low-pass taps of least phase, by spectral factorisation; order 1 is Haar."""
    if not 1 <= order <= 10:
        raise ValueError(f"order {order} is not within 1..10")
    poly = np.array([1.0])
    for _ in range(order):
        poly = np.convolve(poly, [1.0, 1.0])
    # roots of the binomial remainder in y = (2 - z - 1/z) / 4; of each pair z, 1/z the one inside the circle
    for y in np.roots([math.comb(order - 1 + k, k) for k in range(order - 1, -1, -1)]):
        pair = np.roots([1, 4 * y - 2, 1])
        poly = np.convolve(poly, [1, -pair[np.argmin(np.abs(pair))]])
    taps = poly.real
    return taps * (math.sqrt(2) / taps.sum())


def _split(x: np.ndarray, taps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and high half along the first axis."""
    n = len(taps)
    p = np.pad(x, [(n - 1, n - 1)] + [(0, 0)] * (x.ndim - 1), mode="symmetric")
    size = (x.shape[0] + n - 1) // 2
    high = taps[::-1] * (-1.0) ** np.arange(n)
    rows = [p[1 + j : 1 + j + 2 * size : 2][:size] for j in range(n)]
    return sum(t * r for t, r in zip(taps, rows)), sum(t * r for t, r in zip(high, rows))


def _merge(low: np.ndarray, high: np.ndarray, taps: np.ndarray) -> np.ndarray:
    n, size = len(taps), low.shape[0]
    out = np.zeros((2 * size + n - 2, *low.shape[1:]))
    for half, t in ((low, taps), (high, taps[::-1] * (-1.0) ** np.arange(n))):
        for j in range(n):
            out[j : j + 2 * size : 2] += t[j] * half
    return out[n - 2 : 2 * size]


def decompose(x: np.ndarray, order: int, levels: int) -> list:
    """[low-pass, (three details) of the coarsest level, ..., of the finest]."""
    taps, details = daubechies(order), []
    for _ in range(levels):
        low, high = _split(x, taps)
        (ll, lh), (hl, hh) = ([y.T for y in _split(half.T, taps)] for half in (low, high))
        details.append((lh, hl, hh))
        x = ll
    return [x, *details[::-1]]


def compose(parts: list, order: int) -> np.ndarray:
    taps, x = daubechies(order), parts[0]
    for lh, hl, hh in parts[1:]:
        x = x[: lh.shape[0], : lh.shape[1]]
        x = _merge(_merge(x.T, lh.T, taps).T, _merge(hl.T, hh.T, taps).T, taps)
    return x


def map_pairs(images: DataFrame, fuse: Callable[[np.ndarray, np.ndarray], np.ndarray], keep: tuple[str, ...] = ()) -> DataFrame:
    """Image rows (img, h, w, fused, keep...) with ``fuse`` of channels a and b, one image at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda k: batch.column(batch.schema.get_field_index(k))  # noqa: B023, E731
            fused = arrays.list_column([fuse(a, b) for a, b in arrays.images(batch, "a", "b")])
            yield pa.RecordBatch.from_arrays([*(col(k) for k in ("img", "h", "w")), fused, *(col(k) for k in keep)], names=["img", "h", "w", "fused", *keep])

    some = images.select("img", "h", "w", "a", "b", *keep)
    types = ", ".join(f"{k} {some.schema[k].dataType.simpleString()}" for k in ("img", "h", "w"))
    return some.mapInArrow(run, types + ", fused array<double>" + "".join(f", {k} {some.schema[k].dataType.simpleString()}" for k in keep))


def fuse_wavelet(images: DataFrame, order: int = 4, levels: int = 2, cut: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Image rows with ``fused``: mean of the low-pass images, the larger of each detail (first on ties), clipped to 0..255.

    ``cut`` rounds to 9 places and cuts off to whole levels; columns to ``keep`` travel with their row.  Odd sizes come back cropped.
    """
    daubechies(order)

    def one(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = decompose(a, order, levels), decompose(b, order, levels)
        details = [tuple(np.where(np.abs(np.round(p, 9)) >= np.abs(np.round(q, 9)), p, q) for p, q in zip(k, m)) for k, m in zip(x[1:], y[1:])]
        f = np.clip(compose([(x[0] + y[0]) / 2, *details], order)[: a.shape[0], : a.shape[1]], 0, 255)
        return np.trunc(np.round(f, 9)) if cut else f

    return map_pairs(images, one, keep)
