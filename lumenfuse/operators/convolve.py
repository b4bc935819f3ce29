"""Filters over pixel relations (img, r, c, v): correlation with decimation, convolution with upsampling, blurs, gradients.

A line of an image (a row or a column, bounded by the image's side) is one array; a filter is an expression over it, so
each direction costs one shuffle and everything stays in built-in functions.  The border rule is an argument of every filter.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What lies beyond the border: mirrored without or with the edge pixel, the other side, the edge pixel, nothing, the edge pixel
#: plus the mirrored difference to it; ``dont-compute`` gives 0 wherever the filter would leave the image.
EDGES = ("reflect1", "reflect2", "circular", "repeat", "zero", "extend", "dont-compute")


def _folded(i: Column, n: Column, edges: str) -> Column:
    """The place inside 0..n-1 that stands for place i."""
    if edges in ("reflect1", "extend"):
        period = F.greatest(2 * (n - 1), F.lit(1))
        return F.least(F.pmod(i, period), period - F.pmod(i, period))
    if edges == "reflect2":
        return F.least(F.pmod(i, 2 * n), 2 * n - 1 - F.pmod(i, 2 * n))
    if edges == "circular":
        return F.pmod(i, n)
    return F.greatest(F.lit(0), F.least(i, n - 1))


def _filtered(line: Column, taps: Sequence[float], offsets: Sequence[int], at: Column, edges: str, field: str | None = None) -> Column:
    """Sum of taps times values of ``line`` at ``at`` plus each offset."""
    n = F.size(line)
    value = lambda i: F.get(line, i.cast("int"))[field] if field else F.get(line, i.cast("int"))

    def term(tap: float, offset: int) -> Column:
        i = at + offset
        x = value(_folded(i, n, edges))
        if edges == "zero":
            x = F.when((i >= 0) & (i < n), x).otherwise(0.0)
        if edges == "extend":
            x = F.when(i < 0, 2 * value(F.lit(0)) - x).when(i >= n, 2 * value(n - 1) - x).otherwise(x)
        return x * float(tap)

    total = sum((term(t, o) for t, o in zip(taps, offsets)), F.lit(0.0))
    if edges == "dont-compute":
        return F.when((at + min(offsets) >= 0) & (at + max(offsets) < n), total).otherwise(0.0)
    return total


def _lines(pix: DataFrame, line: str, at: str, *values: str) -> DataFrame:
    """(img, line, x): all pixels of a row or column in order."""
    both = F.sort_array(F.collect_list(F.struct(at, *values)))  # one side of one image
    return pix.groupBy("img", line).agg(F.transform(both, lambda p: F.struct(*[p[v].cast("double").alias(v) for v in values])).alias("x"))


def _check(kernel: Sequence[Sequence[float]], edges: str) -> list[list[float]]:
    if edges not in EDGES:
        raise ValueError(f"unknown border {edges!r}; one of {EDGES}")
    rows = [list(map(float, row)) for row in kernel]
    if not rows or not rows[0] or any(len(r) != len(rows[0]) for r in rows):
        raise ValueError("a filter is a matrix with at least one tap")
    return rows


def _apply(pix: DataFrame, rows: list[list[float]], edges: str, offsets: tuple[list[int], list[int]], step: tuple[int, int], start: tuple[int, int], stop: tuple[int, int] | None) -> DataFrame:
    """Every row of the filter along the rows of the image, then their sum along its columns."""
    places = lambda n, k: F.sequence(F.lit(start[k]), (F.lit(stop[k]) if stop else n) - 1, F.lit(step[k]))
    names = [f"k{i}" for i in range(len(rows))]
    along = _lines(pix, "r", "c", "v")
    cells = F.transform(places(F.size("x"), 1), lambda o: F.struct(*[_filtered(F.col("x"), taps, offsets[1], o, edges, "v").alias(k) for taps, k in zip(rows, names)]))
    one = along.select("img", "r", F.posexplode(cells).alias("c", "z")).select("img", "r", "c", *[f"z.{k}" for k in names])
    down = _lines(one, "c", "r", *names)
    total = lambda o: sum((_filtered(F.col("x"), [1.0], [i], o, edges, k) for i, k in zip(offsets[0], names)), F.lit(0.0))
    if edges == "dont-compute":
        inside = lambda o: (o + min(offsets[0]) >= 0) & (o + max(offsets[0]) < F.size("x"))
        cells = F.transform(places(F.size("x"), 0), lambda o: F.when(inside(o), total(o)).otherwise(0.0))
    else:
        cells = F.transform(places(F.size("x"), 0), total)
    return down.select("img", "c", F.posexplode(cells).alias("r", "v")).select("img", "r", "c", "v")


def corr_down(pix: DataFrame, kernel: Sequence[Sequence[float]], edges: str = "reflect1", step: tuple[int, int] = (1, 1), start: tuple[int, int] = (0, 0), stop: tuple[int, int] | None = None) -> DataFrame:
    """Correlation, then every ``step``-th pixel from ``start`` up to ``stop`` (rows, columns; counted from 0, the end left out)."""
    rows = _check(kernel, edges)
    offsets = tuple([i - n // 2 for i in range(n)] for n in (len(rows), len(rows[0])))
    return _apply(pix, rows, edges, offsets, step, start, stop)


def convolve(pix: DataFrame, kernel: Sequence[Sequence[float]], edges: str = "reflect1") -> DataFrame:
    """Convolution (the filter is turned round) of the image's size."""
    rows = _check(kernel, edges)
    offsets = tuple([(n - 1) // 2 - i for i in range(n)] for n in (len(rows), len(rows[0])))
    return _apply(pix, rows, edges, offsets, (1, 1), (0, 0), None)


def upsample(pix: DataFrame, step: tuple[int, int], start: tuple[int, int] = (0, 0), stop: tuple[int, int] | None = None) -> DataFrame:
    """Pixels at every ``step``-th place from ``start``, zeros between; of size ``stop``, or step times the image's."""
    out = pix
    for line, at, k in (("r", "c", 1), ("c", "r", 0)):
        i = lambda o: o - start[k]  # noqa: B023, E731
        n = F.lit(stop[k]) if stop else F.size("x") * step[k] + start[k] // step[k] * step[k]
        cell = lambda o: F.coalesce(F.when((i(o) >= 0) & (i(o) % step[k] == 0), F.get(F.col("x"), F.floor(i(o) / step[k]).cast("int"))["v"]), F.lit(0.0))  # noqa: B023, E731
        out = _lines(out, line, at, "v").select("img", line, F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), cell)).alias(at, "v"))
    return out.select("img", "r", "c", "v")


def up_conv(pix: DataFrame, kernel: Sequence[Sequence[float]], edges: str = "reflect1", step: tuple[int, int] = (1, 1), start: tuple[int, int] = (0, 0), stop: tuple[int, int] | None = None) -> DataFrame:
    """Upsampling, then convolution."""
    return convolve(upsample(pix, step, start, stop), kernel, edges)


def binomial(n: int) -> list[float]:
    """Taps of Pascal's triangle, of sum 1."""
    if n < 2:
        raise ValueError("at least two taps")
    return [math.comb(n - 1, k) / 2 ** (n - 1) for k in range(n)]


def blur_down(pix: DataFrame, levels: int = 1, taps: Sequence[float] | None = None) -> DataFrame:
    """Blurred and halved ``levels`` times."""
    taps = list(taps or binomial(5))
    taps = [t / sum(taps) for t in taps]
    for _ in range(levels):
        pix = corr_down(corr_down(pix, [[t] for t in taps], step=(2, 1)), [taps], step=(1, 2))
    return pix


def blur_up(pix: DataFrame, levels: int = 1, taps: Sequence[float] | None = None) -> DataFrame:
    """Doubled and smoothed ``levels`` times; taps as they are."""
    taps = list(taps or binomial(5))
    for _ in range(levels):
        pix = up_conv(up_conv(pix, [[t] for t in taps], step=(2, 1)), [taps], step=(1, 2))
    return pix


def blur(pix: DataFrame, shape: tuple[int, int], levels: int = 1, taps: Sequence[float] | None = None) -> DataFrame:
    """Low-pass images of ``shape``: halved ``levels`` times and brought back to their size."""
    taps = list(taps or binomial(5))
    taps = [t / sum(taps) for t in taps]
    sizes = [shape]
    for _ in range(levels):
        pix = blur_down(pix, 1, taps)
        sizes.append(tuple(-(-n // 2) for n in sizes[-1]))
    for h, w in sizes[-2::-1]:
        pix = up_conv(pix, [taps], step=(1, 2), stop=(-(-h // 2), w))
        pix = up_conv(pix, [[t] for t in taps], step=(2, 1), stop=(h, w))
    return pix


# Five-tap smoothing and derivative filters that match each other.
SMOOTH = (0.037659, 0.249153, 0.426375, 0.249153, 0.037659)
SLOPE = (-0.109604, -0.276691, 0.0, 0.276691, 0.109604)


def gradient(pix: DataFrame, edges: str = "dont-compute") -> DataFrame:
    """(img, r, c, dx, dy): derivatives along the rows and along the columns."""
    two = lambda down, across: corr_down(corr_down(pix, [[t] for t in down], edges), [list(across)], edges)
    dx, dy = two(SMOOTH, SLOPE).withColumnRenamed("v", "dx"), two(SLOPE, SMOOTH).withColumnRenamed("v", "dy")
    return dx.join(dy, ["img", "r", "c"])


def high_from_low(taps: Sequence[float]) -> list[float]:
    """The high-pass partner of a low-pass filter: turned round, every second sign changed."""
    n = len(taps)
    return [taps[i] * (-1.0) ** (i + 1 - -(-n // 2)) for i in range(n - 1, -1, -1)]


def box(pix: DataFrame, size: int, edges: str = "reflect2") -> DataFrame:
    """Mean over size x size."""
    return corr_down(pix, [[1 / size**2] * size] * size, edges)


def shift(pix: DataFrame, shape: tuple[int, int], by: tuple[int, int]) -> DataFrame:
    """Moved down and right, what leaves on one side comes in on the other."""
    return pix.withColumns({"r": F.pmod(F.col("r") + by[0], F.lit(shape[0])).cast("int"), "c": F.pmod(F.col("c") + by[1], F.lit(shape[1])).cast("int")})


def part(pix: DataFrame, start: tuple[int, int], shape: tuple[int, int]) -> DataFrame:
    """The pixels of a rectangle, counted from its corner."""
    inside = (F.col("r") >= start[0]) & (F.col("r") < start[0] + shape[0]) & (F.col("c") >= start[1]) & (F.col("c") < start[1] + shape[1])
    return pix.where(inside).withColumns({"r": F.col("r") - start[0], "c": F.col("c") - start[1]})


def inner_product(pix: DataFrame, one: str, other: str) -> DataFrame:
    return pix.groupBy("img").agg(F.sum(F.col(one) * F.col(other)).alias("inner"))
