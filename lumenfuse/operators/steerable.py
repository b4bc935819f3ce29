"""Steerable pyramids in the Fourier domain as relations (img, level, band, h, w, px, imag), and steering of their bands.

Level 0 is the high-pass residual (band 0), levels 1 to ``height`` hold ``order + 1`` oriented bands, from fine to
coarse, and the level after them is the low-pass residual (band 0).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfuse.operators import arrays


def max_height(shape: tuple[int, int]) -> int:
    return max(0, int(math.floor(math.log2(min(shape)))) - 2)


def _polar(shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """log2 of the radius (1 is half the sampling rate) and the angle, zero frequency in the middle."""
    y, x = ((np.arange(n) - n // 2) / (n / 2) for n in shape)
    radius = np.hypot(x[None, :], y[:, None])
    radius[shape[0] // 2, shape[1] // 2] = 2 / shape[1]
    return np.log2(radius), np.arctan2(y[:, None], x[None, :])


def _passes(log_radius: np.ndarray, octave: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Low and high pass whose squares add up to 1, crossing ``width`` / 2 below the octave."""
    t = np.clip((log_radius + octave + width / 2) / width, -0.5, 0.5) * math.pi / 2 + math.pi / 4
    return np.cos(t), np.sin(t)


def _oriented(angle: np.ndarray, band: int, order: int, analytic: bool) -> np.ndarray:
    n = order + 1
    gain = math.sqrt(4**order * math.factorial(order) ** 2 / (n * math.factorial(2 * order)))
    c = np.cos(angle - math.pi * band / n)
    return gain * c**order * (2.0 * (c > 1e-12) if analytic else 1.0)


def _half(a: np.ndarray) -> tuple[slice, slice]:
    """The lower half of the frequencies: half the size, its own middle on this one's middle."""
    start = [n // 2 - (n + 1) // 2 // 2 for n in a.shape]
    return tuple(slice(s, s + (n + 1) // 2) for s, n in zip(start, a.shape))


def decompose(x: np.ndarray, height: int, order: int = 3, width: float = 1.0, analytic: bool = False) -> list[tuple[int, int, np.ndarray]]:
    """(level, band, values); ``analytic`` bands are complex, their real parts being the plain ones."""
    if not 0 <= height <= max_height(x.shape):
        raise ValueError(f"height {height} is not within 0..{max_height(x.shape)}")
    if not 0 <= order <= 15:
        raise ValueError(f"order {order} is not within 0..15")
    back = lambda d: np.fft.ifft2(np.fft.ifftshift(d))
    log_radius, angle = _polar(x.shape)
    low, high = _passes(log_radius, 0, width)
    spectrum = np.fft.fftshift(np.fft.fft2(x))
    out = [(0, 0, back(spectrum * high).real)]
    spectrum = spectrum * low
    for level in range(1, height + 1):
        high = _passes(log_radius, level, width)[1]
        for band in range(order + 1):
            v = back((-1j) ** order * spectrum * high * _oriented(angle, band, order, analytic))
            out.append((level, band, v if analytic else v.real))
        cut = _half(spectrum)
        log_radius, angle = log_radius[cut], angle[cut]
        spectrum = spectrum[cut] * _passes(log_radius, level, width)[0]
    return [*out, (height + 1, 0, back(spectrum).real)]


def compose(parts: list[tuple[int, int, np.ndarray]], order: int = 3, width: float = 1.0, levels: set[int] | None = None, bands: set[int] | None = None) -> np.ndarray:
    """The image from its plain bands; only those of ``levels`` and ``bands`` if given."""
    by = {(level, band): v for level, band, v in parts}
    height, shape = max(k for k, _ in by) - 1, by[0, 0].shape
    forth = lambda v: np.fft.fftshift(np.fft.fft2(np.real(v)))
    wanted = lambda level: levels is None or level in levels

    def inner(level: int, log_radius: np.ndarray, angle: np.ndarray) -> np.ndarray:
        if level > height:
            return forth(by[level, 0]) * wanted(level)
        out = np.zeros(log_radius.shape, complex)
        cut = _half(out)
        out[cut] = inner(level + 1, log_radius[cut], angle[cut]) * _passes(log_radius[cut], level, width)[0]
        if wanted(level):
            high = _passes(log_radius, level, width)[1]
            for band in range(order + 1):
                if bands is None or band in bands:
                    out += 1j**order * forth(by[level, band]) * high * _oriented(angle, band, order, False)
        return out

    log_radius, angle = _polar(shape)
    low, high = _passes(log_radius, 0, width)
    spectrum = inner(1, log_radius, angle) * low + forth(by[0, 0]) * high * wanted(0)
    return np.fft.ifft2(np.fft.ifftshift(spectrum)).real


def steerable_pyramid(images: DataFrame, channel: str = "a", height: int | None = None, order: int = 3, analytic: bool = False) -> DataFrame:
    """One row per band; ``imag`` is null for plain bands and residuals.  Without ``height`` as high as each image allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            many = [decompose(x, max_height(x.shape) if height is None else min(height, max_height(x.shape)), order, analytic=analytic) for (x,) in arrays.images(batch, channel)]
            parts = [p for image in many for p in image]
            img = batch.column(batch.schema.get_field_index("img")).take(pa.array(np.repeat(np.arange(len(many)), [len(x) for x in many])))
            whole = [pa.array(x, pa.int32()) for x in ([k for k, _, _ in parts], [b for _, b, _ in parts], [v.shape[0] for _, _, v in parts], [v.shape[1] for _, _, v in parts])]
            imag = pa.array([v.imag.ravel() if np.iscomplexobj(v) else None for _, _, v in parts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([img, *whole, arrays.list_column([v.real for _, _, v in parts]), imag], names=["img", "level", "band", "h", "w", "px", "imag"])

    return images.select("img", "h", "w", channel).mapInArrow(run, f"img {images.schema['img'].dataType.simpleString()}, level int, band int, h int, w int, px array<double>, imag array<double>")


def steering_weights(order: int, angle: float) -> np.ndarray:
    """What to multiply each band with to get the band at ``angle``."""
    n = order + 1
    harmonics = np.arange(n % 2 == 0, n, 2)
    at = lambda t: np.concatenate([np.cos(np.outer(harmonics, t)), np.sin(np.outer(harmonics, t))])
    return np.linalg.pinv(at(math.pi * np.arange(n) / n)) @ at(np.array([angle]))[:, 0]


def steer(pyramid: DataFrame, angle: float, order: int = 3) -> DataFrame:
    """(img, level, h, w, px): the band at any angle, for each level of a steerable pyramid that has oriented bands."""
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in steering_weights(order, angle)]), F.col("band") + 1)
    some = pyramid.select("img", "level", "h", "w", "band", F.transform("px", lambda v: v * weight).alias("px"))
    listed = some.groupBy("img", "level", "h", "w").agg(F.collect_list("px").alias("all"), F.count(F.lit(1)).alias("n"))  # order + 1 bands at most
    none = F.array_repeat(F.lit(0.0), F.col("h") * F.col("w"))
    many = listed.where(F.col("n") == order + 1) if order else listed
    return many.select("img", "level", "h", "w", F.aggregate("all", none, lambda s, v: F.zip_with(s, v, lambda p, q: p + q)).alias("px"))
