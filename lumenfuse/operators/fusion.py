"""Fusion of a pair of channels, on image rows or on pixels; results clipped to 0..255 and cut off."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfuse.functions import color
from lumenfuse.functions.color import to_byte
from lumenfuse.operators import pyramid, wavelet
from lumenfuse.sources import raster


def fuzzy(trip: DataFrame) -> DataFrame:
    """Fuzzy maximum: (img, r, c, fused)."""
    return trip.select("img", "r", "c", F.greatest("a", "b").cast("int").alias("fused"))


def pca(pix: DataFrame) -> DataFrame:
    """Weights from the main eigenvector of the 2 x 2 covariance, in closed form; one aggregate joined back by image.

    The mix is rounded to 9 places before it is cut off, so that equal levels stay what they are.  A vanishing sum of the eigenvector's parts leaves a null.
    """
    w = pix.groupBy("img").agg(F.var_samp("a").alias("p"), F.var_samp("b").alias("q"), F.covar_samp("a", "b").alias("k"))
    big = F.expr("(p + q) / 2 + sqrt((p - q) * (p - q) / 4 + k * k)")
    x = F.when(F.col("k") != 0, big - F.col("q")).when(F.col("p") >= F.col("q"), 1.0).otherwise(0.0)
    y = F.when(F.col("k") != 0, F.col("k")).when(F.col("p") >= F.col("q"), 0.0).otherwise(1.0)
    w = w.select("img", (x / F.nullif(x + y, F.lit(0.0))).alias("wa"), (y / F.nullif(x + y, F.lit(0.0))).alias("wb"))
    return pix.join(w, "img").select("img", "r", "c", to_byte(F.round(F.expr("wa * a + wb * b"), 9)).alias("fused"))


def haar(pix: DataFrame, cut: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One-level Haar wavelet fusion: mean of the approximations, the larger detail of each band (first on ties).

    Details are compared to 9 places, so that equal ones tie.  A 2 x 2 block is one group; odd sizes repeat the last row or column and are cropped again.  Without ``cut``
    the result is clipped only; columns to ``keep`` travel with their pixel, so nothing is joined back.
    """
    end: Callable[[Column], Column] = to_byte if cut else color.clip
    block = pix.groupBy("img", F.floor(F.col("r") / 2).cast("int").alias("R"), F.floor(F.col("c") / 2).cast("int").alias("C"))
    at = lambda x, i, j: F.any_value(F.when((F.col("r") % 2 == i) & (F.col("c") % 2 == j), F.col(x)), True)
    b = block.agg(*[at(x, i, j).alias(f"{x}{i}{j}") for x in ("a", "b", *keep) for i in (0, 1) for j in (0, 1)], F.max(F.col("r") % 2).alias("rr"), F.max(F.col("c") % 2).alias("cc"))
    for x in "ab":
        b = b.withColumns({f"{x}01": F.coalesce(f"{x}01", f"{x}00"), f"{x}10": F.coalesce(f"{x}10", f"{x}00")})
        b = b.withColumn(f"{x}11", F.coalesce(f"{x}11", F.when(F.col("rr") == 0, F.col(f"{x}01")).otherwise(F.col(f"{x}10"))))
    signs = {"ll": (1, 1, 1, 1), "lh": (1, 1, -1, -1), "hl": (1, -1, 1, -1), "hh": (1, -1, -1, 1)}
    mixed = lambda x, s: sum((k * F.col(f"{x}{i}{j}") for k, (i, j) in zip(s, ((0, 0), (0, 1), (1, 0), (1, 1)))), F.lit(0.0)) / 2
    for k, s in signs.items():
        one, two = mixed("a", s), mixed("b", s)
        b = b.withColumn(k, (one + two) / 2 if k == "ll" else F.when(F.abs(F.round(one, 9)) >= F.abs(F.round(two, 9)), one).otherwise(two))
    back = F.array(*[F.struct((2 * F.col("R") + i).alias("r"), (2 * F.col("C") + j).alias("c"), end(sum((s[2 * i + j] * F.col(k) for k, s in signs.items()), F.lit(0.0)) / 2).alias("fused"), *[F.col(f"{k}{i}{j}").alias(k) for k in keep]) for i in (0, 1) for j in (0, 1)])
    out = b.select("img", F.col("rr").alias("_rr"), F.col("cc").alias("_cc"), F.explode(back).alias("x"))
    return out.where("(x.r % 2 <= _rr) and (x.c % 2 <= _cc)").select("img", "x.r", "x.c", "x.fused", *[f"x.{k}" for k in keep])


FUSIONS = {"fuzzy": fuzzy, "pca": pca, "haar": haar}


def fuse(pix: DataFrame, mode: str) -> DataFrame:
    if mode not in FUSIONS:
        raise ValueError(f"unknown fusion {mode!r}; one of {sorted(FUSIONS)}")
    return FUSIONS[mode](pix)


SPACES = {"ycbcr": (color.rgb_to_ycbcr, color.ycbcr_to_rgb), "hsi": (color.rgb_to_hsi, color.hsi_to_rgb)}


def fuse_color(pix: DataFrame, space: str) -> DataFrame:
    """Haar fusion of ``grey`` with the brightness of a colour image: (img, r, c, red, green, blue) in and out.

    Brightness is Y of YCbCr or I of HSI (as 0..255); the two other channels stay.  They and the fused brightness are
    rounded to 9 places before the way back, which cuts off to whole levels.
    """
    if space not in SPACES:
        raise ValueError(f"unknown colour space {space!r}; one of {sorted(SPACES)}")
    there, back = SPACES[space]
    x = there(F.col("red").cast("double"), F.col("green").cast("double"), F.col("blue").cast("double"))
    light, p, q = x if space == "ycbcr" else (x[2] * 255, x[0], x[1])
    fused = haar(pix.select("img", "r", "c", F.col("grey").cast("double").alias("a"), light.alias("b"), p.alias("p"), q.alias("q")), cut=False, keep=("p", "q"))
    v, p, q = (F.round(F.col(k), 9) for k in ("fused", "p", "q"))
    rgb = back(v, p, q) if space == "ycbcr" else back(p, q, v / 255)
    return fused.select("img", "r", "c", *[k.alias(n) for k, n in zip(rgb, ("red", "green", "blue"))])


def fuse_color_images(images: DataFrame, space: str, method: str = "laplacian", levels: int | None = None, order: int = 4) -> DataFrame:
    """``fuse_color`` on image rows (img, h, w, grey, red, green, blue), for methods that need the whole image.

    Methods: ``laplacian`` (4 levels), ``wavelet`` (Daubechies of ``order``, 2 levels), ``pca`` (brightness cut off to whole levels), ``fuzzy``.
    """
    if space not in SPACES:
        raise ValueError(f"unknown colour space {space!r}; one of {sorted(SPACES)}")
    there, back = SPACES[space]
    x = lambda z: there(*(z[k].cast("double") for k in ("red", "green", "blue")))
    split = (lambda z: x(z)) if space == "ycbcr" else (lambda z: (x(z)[2] * 255, x(z)[0], x(z)[1]))
    parts = F.transform(F.arrays_zip("red", "green", "blue"), lambda z: F.struct(*[k.alias(n) for k, n in zip(split(z), ("light", "p", "q"))]))
    rows = images.select("img", "h", "w", F.transform("grey", lambda g: g.cast("double")).alias("a"), parts.alias("x")).select("img", "h", "w", "a", F.col("x.light").alias("b"), F.col("x.p").alias("p"), F.col("x.q").alias("q"))
    if method == "laplacian":
        fused = pyramid.fuse_laplacian(rows, levels or 4, cut=False, keep=("p", "q"))
    elif method == "wavelet":
        fused = wavelet.fuse_wavelet(rows, order, levels or 2, cut=False, keep=("p", "q"))
    elif method == "pca":
        mixed = raster.image_rows(pca(raster.pixels(rows, "a", "b")), "fused").select("img", "fused")
        fused = mixed.join(rows.select("img", "h", "w", "p", "q"), "img")
    elif method == "fuzzy":
        fused = rows.select("img", "h", "w", F.zip_with("a", "b", lambda p, q: F.greatest(p, q)).alias("fused"), "p", "q")
    else:
        raise ValueError(f"unknown method {method!r}")

    def rgb(z: Column) -> Column:
        v, p, q = (F.round(z[k], 9) for k in ("fused", "p", "q"))
        out = back(v, p, q) if space == "ycbcr" else back(p, q, v / 255)
        return F.struct(*[k.alias(n) for k, n in zip(out, ("red", "green", "blue"))])

    done = fused.select("img", "h", "w", F.transform(F.arrays_zip("fused", "p", "q"), rgb).alias("x"))
    return done.select("img", "h", "w", "x.red", "x.green", "x.blue")
