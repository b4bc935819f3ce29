"""Batch evaluation: all scores of fused images by method, with averages and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfuse.operators import metrics as M
from lumenfuse.operators import report, windowed
from lumenfuse.sources import raster

#: Columns of a batch report, in order: information, image, structure, visual, quality.
COLUMNS = ["EN", "MI", "FMI", "SCD", "QABF", "SF", "SSIM", "MS_SSIM", "VIF", "VIFF", "SD", "MLI", "AG", "PSNR"]
WINDOWED = ("FMI", "SSIM", "MS_SSIM", "VIF", "VIFF")


def evaluate(images: DataFrame, keys: tuple[str, ...] = ("Model", "ImageName"), windows: tuple[str, ...] = WINDOWED) -> DataFrame:
    """``keys`` and the batch scores of image rows (keys..., h, w, a, b, f): sources a and b, fused image f.

    Without ``windows`` only what aggregates can express.  A row is known by its keys, which must be unique together.
    """
    named = images.select(F.struct(*keys).alias("img"), "h", "w", "a", "b", "f")
    scores = M.native_scores(raster.pixels(named, "a", "b", "f"))
    if windows:
        scores = scores.join(windowed.score(named, *windows), "img")
    return scores.select(*[F.col(f"img.{k}").alias(k) for k in keys], *[c for c in COLUMNS if c in scores.columns])


def report_rows(images: DataFrame, windows: tuple[str, ...] = WINDOWED) -> DataFrame:
    """Scores by method and image, with an AVERAGE row for each method."""
    rows = evaluate(images, windows=windows)
    return report.with_average(rows, [c for c in COLUMNS if c in rows.columns])


def summarise(images: DataFrame, windows: tuple[str, ...] = WINDOWED) -> DataFrame:
    """The averages of each method."""
    rows = evaluate(images, windows=windows)
    return report.summary(rows, [c for c in COLUMNS if c in rows.columns])
