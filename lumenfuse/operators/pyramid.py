"""Fusion by Laplacian pyramid on pixel relations, and the bands of such pyramids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfuse.operators import bands
from lumenfuse.sources import raster

#: Blur before halving, and filter after doubling, of sum 1 and 2; their sums are exact for whole grey levels.
DOWN, UP = [t / 16 for t in (1.0, 4.0, 6.0, 4.0, 1.0)], [t / 8 for t in (1.0, 4.0, 6.0, 4.0, 1.0)]
#: Details no further apart tie: sums of a brightness in thirds or thousandths differ by about 1e-14 with their order, unequal details of whole levels and thirds by 1.2e-12 or more on four levels.
TIE = 1e-12


def laplacian_pyramid(images: DataFrame, *channels: str, levels: int = 4) -> DataFrame:
    """Bands (img, h, w, level, band, r, c, channels...) of image rows, fine to coarse; an image that is one pixel wide or high is not halved further."""
    rows = bands.from_images(images, *(channels or ("a",)))
    return bands.laplacian_pyramid(rows, levels, DOWN, UP, "mirror", "reflect1", whole_grid=True, least=2)


def halvings(levels: int) -> Column:
    """How often an image of sides h and w is halved: until a side is 1, at most ``levels`` times."""
    side = F.least("h", "w")
    return F.when(side < 2, 0).otherwise(F.least(F.lit(levels), F.length(F.bin(side - 1))))


def fuse_laplacian(images: DataFrame, levels: int = 4, cut: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Image rows with ``fused``: mean of the low-pass images, the larger detail of each band (first on ties, see ``TIE``), clipped to 0..255.

    Both sources are two values of one pyramid, so nothing is joined but the columns to ``keep``.  ``cut`` cuts off to whole levels.
    """
    larger = F.when(F.abs("a") >= F.abs("b") - TIE, F.col("a")).otherwise(F.col("b"))
    chosen = F.when(F.col("level") == halvings(levels), (F.col("a") + F.col("b")) / 2).otherwise(larger)
    pyr = laplacian_pyramid(images, "a", "b", levels=levels).withColumn("fused", chosen).drop("a", "b")
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.col("fused")))
    out = bands.laplacian_image(pyr, levels, UP, whole_grid=True).select("img", "r", "c", (F.floor(clipped).cast("double") if cut else clipped).alias("fused"))
    rows = raster.image_rows(out, "fused")
    return rows.join(images.select("img", *keep), "img") if keep else rows
