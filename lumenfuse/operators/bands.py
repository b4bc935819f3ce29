"""Pyramids as relations: one row per coefficient, built, changed and folded back by joins with small kernel tables.

``(img, h, w, level, band, r, c, values...)``, where h and w are the sides of the image.  A step of a pyramid, one level down or one level up, is a join of
every coefficient with the rows of a kernel table that start at its place (band and parity of row and column), and one aggregation that
adds up what arrives at the same place.  Coefficients that a step does not touch join a row that hands them on, so a pyramid
of any height is one chain without branches, and no level is computed twice.  Images are hash-partitioned once; all
steps group by image and more, so they need no further shuffle.

Kinds of pyramids (band 0 is always the low-pass image of its level):

* Gaussian: (level, 0) are the halved images;
* Laplacian: (level, 0) are differences to the doubled next level, the last level is low-pass;
* QMF: bands 1 (horizontal), 2 (vertical), 3 (diagonal) of levels 1 to height, band 0 of level height;
* steerable: bands 1, 2, ... of levels 1 to height, band 0 of level height, and band 1 of level 0, what lies above all of them.

Access to bands is a filter on level and band; a band is replaced with ``set_band``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfuse.operators.convolve import binomial, high_from_low
from lumenfuse.operators.filter_banks import FilterBank

#: Borders: mirrored without or with the edge pixel, the other side, the edge pixel, nothing; "mirror" is reflect1 but on lines of at most two pixels, which repeat.
EDGES = ("reflect1", "reflect2", "circular", "repeat", "zero", "mirror")
Kernel = Sequence[Sequence[float]]
Row = tuple[int, int, int, int, int, int, int, int, float]


def from_images(images: DataFrame, *channels: str) -> DataFrame:
    """Level 0, band 0 of image rows (img, h, w, channels...); one shuffle of image rows, the last one of a pyramid."""
    # the number of partitions is named, or adaptive execution would merge them by the bytes of image rows, which pixels exceed manyfold
    rows = images.select("img", "h", "w", *channels).repartition(int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")), "img")
    z = rows.select("img", "h", "w", F.posexplode(F.arrays_zip(*channels)).alias("p", "z"))
    zero = F.lit(0)
    return z.select("img", "h", "w", zero.alias("level"), zero.alias("band"), F.floor(F.col("p") / F.col("w")).cast("int").alias("r"), (F.col("p") % F.col("w")).cast("int").alias("c"), *[F.col(f"z.{x}").cast("double").alias(x) for x in channels])


def values_of(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c not in ("img", "h", "w", "level", "band", "r", "c")]


def max_height(shape: tuple[int, int], taps: int) -> int:
    """How often an image can be halved before a side is shorter than the filter; an image of one line counts its length only."""
    n = max(shape) if 1 in shape else min(shape)
    return 0 if n < taps else 1 + max_height(tuple(x if x == 1 else x // 2 for x in shape), taps)


def set_band(pyramid: DataFrame, level: int, band: int, new: DataFrame) -> DataFrame:
    """``pyramid`` with one band replaced by ``new(img, r, c, values...)``; images that ``new`` lacks lose the band's coefficients (they count as 0).

    The rows of ``new`` must lie inside the band; a place beyond it is an error when the rows are used.
    """
    here = (F.col("level") == level) & (F.col("band") == band)
    sides = pyramid.where(here).groupBy("img", "h", "w").agg((F.max("r") + 1).alias("_rows"), (F.max("c") + 1).alias("_columns"))
    put = new.select("img", "r", "c", *values_of(pyramid)).join(sides, "img")
    inside = (F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") < F.col("_rows")) & (F.col("c") < F.col("_columns"))
    put = put.where(F.when(inside, True).otherwise(F.raise_error(F.lit("the new band does not fit")).cast("boolean")))
    put = put.withColumns({"level": F.lit(level), "band": F.lit(band)})
    return pyramid.where(~here).unionByName(put.select(*pyramid.columns))


def with_parents(pyramid: DataFrame) -> DataFrame:
    """Coefficients with those above them in the tree: the same band one level up, at half the row and column, as ``parent_`` values (null at the top).

    The tree is that of oriented bands; residual bands (band 0, and level 0) have no parents and are none.
    """
    values = values_of(pyramid)
    up = pyramid.where("band > 0 and level > 0").select("img", (F.col("level") - 1).alias("level"), "band", F.col("r").alias("_r"), F.col("c").alias("_c"), *[F.col(v).alias(f"parent_{v}") for v in values])
    place = {"_r": F.floor(F.col("r") / 2).cast("int"), "_c": F.floor(F.col("c") / 2).cast("int")}
    return pyramid.where("band > 0 and level > 0").withColumns(place).join(up, ["img", "level", "band", "_r", "_c"], "left").select(*pyramid.columns, *[f"parent_{v}" for v in values])


# ---------------------------------------------------------------- one step


def _copies(i: Column, n: Column, reach: int, edges: str) -> Column:
    """All places up to ``reach`` beyond 0..n-1 that stand for place i, itself included."""
    if edges == "zero" or not reach:
        return F.array(i)
    if edges == "mirror":
        return F.when(n > 2, _copies(i, n, reach, "reflect1")).otherwise(_copies(i, n, reach, "repeat"))
    if edges == "repeat":
        far = lambda on, a, b: F.when(on, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
        return F.concat(F.array(i), far(i == 0, F.lit(-reach), F.lit(-1)), far(i == n - 1, n, n - 1 + reach))
    period = {"reflect1": F.greatest(2 * (n - 1), F.lit(1)), "reflect2": 2 * n, "circular": n}[edges]
    mirror = {"reflect1": lambda x: -x, "reflect2": lambda x: -1 - x, "circular": lambda x: x}[edges]
    times = F.ceil(F.lit(float(reach)) / period).cast("int") + 1
    moved = F.flatten(F.transform(F.sequence(-times, times), lambda j: F.array(i + j * period, mirror(i) + j * period)))
    near = F.array_distinct(F.filter(moved, lambda p: (p >= -reach) & (p <= n - 1 + reach)))
    return F.when((i > reach) & (i < n - 1 - reach), F.array(i)).otherwise(near)  # inside only itself


def _table(spark: SparkSession, rows: list[Row]) -> DataFrame:
    """Kernel rows (band, band after, step up or down, parity of r, of c, place of the tap in r, in c, step, tap) as a relation; ``act`` is false for the row that hands on."""
    sent = ["(false, -1, 0, 0, 0, 0, 0, 0, 1, 1.0D)", *(f"(true, {', '.join(map(str, r[:-1]))}, {r[-1]!r}D)" for r in rows)]
    return spark.sql("select * from values " + ", ".join(sent) + " as t(act, src, dst, shift, pr, pc, dr, dc, stride, tap)")


def _kernel_rows(kernel: Kernel, origin: tuple[int, int], turned: bool, step: int, band: int, to: int, shift: int) -> list[Row]:
    """Rows of one filter: the coefficient at place p adds tap * v to place (p - d) / step."""
    out, parities = [], range(2)
    for i, line in enumerate(kernel):
        for j, tap in enumerate(line):
            if tap:
                d = ((len(kernel) // 2 - i, len(line) // 2 - j) if turned else (i - len(kernel) // 2 + origin[0], j - len(line) // 2 + origin[1]))
                out += [(band, to, shift, pr, pc, *d, step, float(tap)) for pr in parities for pc in parities if step == 1 or (pr, pc) == (d[0] % 2, d[1] % 2)]
    return out


def _step(rows: DataFrame, on: Column, kernels: list[Row], edges: str, place: Callable[[], tuple[Column, Column]], grid: tuple[Column, Column], side: Callable[[Column, Column], tuple[Column, Column]]) -> DataFrame:
    """One step: rows where ``on`` go through the kernels, others stay as they are.

    ``place`` is where such a row stands on its ``grid`` (whose borders ``edges`` continues); ``side`` gives the sides of a band (level, band) after the step.
    """
    if edges not in EDGES:
        raise ValueError(f"unknown border {edges!r}; one of {EDGES}")
    values = values_of(rows)
    reach = max(max(abs(k[5]), abs(k[6])) for k in kernels) + 1
    at = place()
    x = rows.withColumns({"act": on, "p": F.when(on, at[0]).otherwise(F.col("r")), "q": F.when(on, at[1]).otherwise(F.col("c"))})
    for k, n in zip(("p", "q"), grid):
        x = x.withColumn(k, F.explode(F.when(F.col("act"), _copies(F.col(k), n.cast("int"), reach, edges)).otherwise(F.array(k))))
    parity = lambda k: F.when(F.col("act"), F.pmod(F.col(k), F.lit(2))).otherwise(0)
    x = x.withColumns({"src": F.when(F.col("act"), F.col("band")).otherwise(-1), "pr": parity("p"), "pc": parity("q")})
    x = x.join(F.broadcast(_table(rows.sparkSession, kernels)), ["act", "src", "pr", "pc"])  # a constant of a few hundred rows
    level = F.col("level") + F.col("shift")
    band = F.when(F.col("act"), F.col("dst")).otherwise(F.col("band"))
    moved = lambda old, k, d: F.when(F.col("act"), F.expr(f"({k} - {d}) div stride").cast("int")).otherwise(F.col(old))
    x = x.select("img", "h", "w", "act", level.alias("level"), band.alias("band"), moved("r", "p", "dr").alias("r"), moved("c", "q", "dc").alias("c"), *[(F.col(v) * F.col("tap")).alias(v) for v in values])
    rows_, columns = side(F.col("level"), F.col("band"))
    x = x.where(~F.col("act") | ((F.col("r") >= 0) & (F.col("c") >= 0) & (F.col("r") < rows_) & (F.col("c") < columns)))
    return x.groupBy("img", "h", "w", "level", "band", "r", "c").agg(*[F.sum(v).alias(v) for v in values])


def _half(n: Column, level: Column) -> Column:
    """A side after ``level`` halvings, rounded up."""
    return F.ceil(n / F.pow(F.lit(2.0), level)).cast("int")


def _halves(level: Column, band: Column | None = None) -> tuple[Column, Column]:
    return _half(F.col("h"), level), _half(F.col("w"), level)


def _outer(column: Sequence[float], row: Sequence[float]) -> list[list[float]]:
    return [[a * b for b in row] for a in column]


def _here() -> tuple[Column, Column]:
    return F.col("r"), F.col("c")


# ---------------------------------------------------------------- Gaussian and Laplacian

#: Five-tap binomial filter whose square has the gain of a halving.
BINOMIAL5 = [t * math.sqrt(2) for t in binomial(5)]


def gaussian_pyramid(rows: DataFrame, height: int, taps: Sequence[float] = BINOMIAL5, edges: str = "reflect1", least: int = 1) -> DataFrame:
    """Levels 0 to ``height``: blurred and halved again and again, as long as no side is below ``least``."""
    down = _kernel_rows(_outer(taps, taps), (0, 0), False, 2, 0, 0, 1)
    for k in range(height):
        here = _halves(F.lit(k))
        # the level itself is handed on beside what goes down, under band 1
        twice = _twice(rows, (F.col("level") == k) & (F.least(*here) >= least))
        rows = _step(twice, F.col("band") == 0, down, edges, _here, here, _halves).withColumn("band", F.lit(0))
    return rows


def _twice(rows: DataFrame, on: Column) -> DataFrame:
    """Rows under band 1, and those ``on`` once more under band 0."""
    return rows.withColumn("band", F.explode(F.when(on, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))


def laplacian_pyramid(rows: DataFrame, height: int, taps: Sequence[float] = BINOMIAL5, up_taps: Sequence[float] | None = None, edges: str = "reflect1", up_edges: str | None = None, whole_grid: bool = False, least: int = 1) -> DataFrame:
    """Levels 0 to ``height`` of differences, the last of them low-pass.

    ``whole_grid``: a doubled image has twice the side before it is cut to its size, which decides what lies beyond an odd border.
    """
    rows = gaussian_pyramid(rows, height, taps, edges, least)
    if not height:
        return rows
    up = [-t for t in (up_taps or taps)], list(up_taps or taps)
    out = _step(_twice(rows, F.col("level") > 0), F.col("band") == 0, _kernel_rows(_outer(*up), (0, 0), True, 1, 0, 1, -1), up_edges or edges, *_upsampled(F.col("level"), whole_grid), _halves)
    return out.withColumn("band", F.lit(0))


def _upsampled(level: Column, whole_grid: bool) -> tuple[Callable[[], tuple[Column, Column]], tuple[Column, Column]]:
    grid = tuple(2 * x for x in _halves(level)) if whole_grid else _halves(level - 1)
    return lambda: (2 * F.col("r"), 2 * F.col("c")), grid


def laplacian_image(pyramid: DataFrame, height: int, up_taps: Sequence[float] = BINOMIAL5, edges: str = "reflect1", levels: set[int] | None = None, whole_grid: bool = False) -> DataFrame:
    """Level 0 again, from all levels or some of them."""
    rows = pyramid if levels is None else pyramid.where(F.col("level").isin(*levels))
    up = _kernel_rows(_outer(up_taps, up_taps), (0, 0), True, 1, 0, 0, -1)
    for k in range(height, 0, -1):
        rows = _step(rows, F.col("level") == k, up, edges, *_upsampled(F.lit(k), whole_grid), _halves)
    return rows


# ---------------------------------------------------------------- two-channel filter banks


def _phases(taps: Sequence[float]) -> tuple[int, list[list[float]]]:
    """(first place of the low band, low-pass and high-pass taps); the high band starts at place 1."""
    return (1 if len(taps) % 2 == 0 else 0), [list(taps), high_from_low(taps)]


def _qmf_sides(start: int) -> Callable[[Column, Column], tuple[Column, Column]]:
    def side(level: Column, band: Column) -> tuple[Column, Column]:
        parent = lambda n: _half(n, level - 1) if not start else F.floor(n / F.pow(F.lit(2.0), level - 1)).cast("int")
        count = lambda n, first: F.when(level > 0, F.ceil((parent(n) - first) / 2).cast("int")).otherwise(n)
        return count(F.col("h"), F.when(band.isin(1, 3), 1).otherwise(start)), count(F.col("w"), F.when(band.isin(2, 3), 1).otherwise(start))

    return side


def qmf_pyramid(rows: DataFrame, height: int, taps: Sequence[float], edges: str = "reflect1") -> DataFrame:
    """Low band and horizontal, vertical, diagonal bands; the low band of one level is parted again in the next.

    Banks of an even number of taps need sides that can be halved ``height`` times, and fold back at the borders with circular ones only.
    """
    start, pair = _phases(taps)
    kernels = [k for band in range(4) for k in _kernel_rows(_outer(pair[band & 1], pair[band >> 1]), ((1 if band & 1 else start), (1 if band >> 1 else start)), False, 2, 0, band, 1)]
    side = _qmf_sides(start)
    for k in range(height):
        rows = _step(rows, (F.col("level") == k) & (F.col("band") == 0), kernels, edges, _here, side(F.lit(k), F.lit(0)), side)
    return rows


def qmf_image(pyramid: DataFrame, height: int, taps: Sequence[float], edges: str = "reflect1", levels: set[int] | None = None, bands: set[int] | None = None) -> DataFrame:
    """Level 0 again; ``levels`` 1 to height and height + 1 (the low band), and ``bands`` of 1, 2, 3 that take part."""
    start, pair = _phases(taps)
    kernels = [k for band in range(4) for k in _kernel_rows(_outer(pair[band & 1], pair[band >> 1]), (0, 0), True, 1, band, 0, -1)]
    side, low = _qmf_sides(start), F.col("band") == 0
    rows = pyramid
    if levels is not None:
        rows = rows.where(F.when(low, F.lit(height + 1 in levels)).otherwise(F.col("level").isin(*levels)))
    if bands is not None:
        rows = rows.where(low | F.col("band").isin(*bands))
    first = lambda bands_: F.when(F.col("band").isin(*bands_), 1).otherwise(start)
    for k in range(height, 0, -1):
        place = lambda: (2 * F.col("r") + first((1, 3)), 2 * F.col("c") + first((2, 3)))
        rows = _step(rows, F.col("level") == k, kernels, edges, place, side(F.lit(k - 1), F.lit(0)), side)
    return rows


# ---------------------------------------------------------------- steerable


def _steerable_sides(level: Column, band: Column) -> tuple[Column, Column]:
    """Oriented bands have the side of the image they were taken from, one level up."""
    own = F.when((band > 0) & (level > 0), level - 1).otherwise(level)
    return _half(F.col("h"), own), _half(F.col("w"), own)


def steerable_bands(rows: DataFrame, height: int, bank: FilterBank, edges: str = "reflect1") -> DataFrame:
    """High-pass residual, ``height`` levels of oriented bands and the low-pass residual, by non-separable kernels."""
    first = _kernel_rows(bank.low0, (0, 0), False, 1, 0, 0, 0) + _kernel_rows(bank.high0, (0, 0), False, 1, 0, 1, 0)
    rows = _step(rows, F.col("band") == 0, first, edges, _here, (F.col("h"), F.col("w")), _steerable_sides)
    level = _kernel_rows(bank.low, (0, 0), False, 2, 0, 0, 1) + [k for b, kernel in enumerate(bank.bands) for k in _kernel_rows(kernel, (0, 0), False, 1, 0, b + 1, 1)]
    for k in range(height):
        rows = _step(rows, (F.col("level") == k) & (F.col("band") == 0), level, edges, _here, _halves(F.lit(k)), _steerable_sides)
    return rows


def steerable_image(pyramid: DataFrame, height: int, bank: FilterBank, edges: str = "reflect1", levels: set[int] | None = None, bands: set[int] | None = None) -> DataFrame:
    """The image from its bands; ``levels`` 0 (high-pass residual), 1 to height, height + 1 (low-pass), and ``bands`` that take part."""
    low, rows = F.col("band") == 0, pyramid
    if levels is not None:
        rows = rows.where(F.when(low, F.lit(height + 1 in levels)).otherwise(F.col("level").isin(*levels)))
    if bands is not None:
        rows = rows.where(low | (F.col("level") == 0) | F.col("band").isin(*bands))
    up = _kernel_rows(bank.low, (0, 0), True, 1, 0, 0, -1) + [k for b, kernel in enumerate(bank.bands) for k in _kernel_rows(kernel, (0, 0), True, 1, b + 1, 0, -1)]
    for k in range(height, 0, -1):
        wide = lambda x: F.when(F.col("band") == 0, 2 * F.col(x)).otherwise(F.col(x))
        rows = _step(rows, F.col("level") == k, up, edges, lambda: (wide("r"), wide("c")), _halves(F.lit(k - 1)), _steerable_sides)
    last = _kernel_rows(bank.low0, (0, 0), True, 1, 0, 0, 0) + _kernel_rows(bank.high0, (0, 0), True, 1, 1, 0, 0)
    return _step(rows, F.col("level") == 0, last, edges, _here, (F.col("h"), F.col("w")), _halves)
