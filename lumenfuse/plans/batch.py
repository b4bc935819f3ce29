"""Batch runs over folders of images: fusion of the pairs of two folders, and scores of folders of fused images.

A data set is a folder with two source folders whose images have the same names; fused images stand in one folder a
method.  Everything is a join by file name; what has no partner ends up in a skip report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfuse.operators import fusion, pyramid, report, wavelet
from lumenfuse.plans import evaluate as E
from lumenfuse.sources import files, raster

METHODS = ("wavelet", "laplacian", "pca", "fuzzy")


def pair_by_name(grey: DataFrame, colour: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, report): image rows (img, h, w, grey, red, green, blue), and names of ``grey`` without a partner of its size."""
    one = grey.select("img", "h", "w", F.col("px").alias("grey"))
    two = colour.select("img", "h", "w", "red", "green", "blue")
    pairs = one.join(two, ["img", "h", "w"])
    return pairs, one.join(two, ["img", "h", "w"], "left_anti").select("img")


def fuse_pairs(pairs: DataFrame, mode: str = "ycbcr", method: str = "wavelet", order: int = 1, levels: int | None = None) -> DataFrame:
    """Fused image rows: (img, h, w, fused) in mode 'grayscale', (img, h, w, red, green, blue) in 'ycbcr' and 'hsi'.

    In grayscale the colour image counts as the mean of its channels.  A source with nothing above 1 counts as 0..1.
    Defaults are those of a batch run: one level of Haar.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; one of {METHODS}")
    pairs = raster.to_scale(pairs, "grey")
    if mode == "grayscale":
        mean = F.transform(F.arrays_zip("red", "green", "blue"), lambda z: (z["red"] + z["green"] + z["blue"]) / 3)
        rows = raster.to_scale(pairs.select("img", "h", "w", F.col("grey").alias("a"), mean.alias("b")), "b")
        if method == "wavelet":
            return wavelet.fuse_wavelet(rows, order, levels or 1)
        if method == "laplacian":
            return pyramid.fuse_laplacian(rows, levels or 4)
        if method == "pca":
            return raster.image_rows(fusion.pca(raster.pixels(rows, "a", "b")), "fused")
        return rows.select("img", "h", "w", F.zip_with("a", "b", lambda x, y: F.floor(F.greatest(x, y)).cast("double")).alias("fused"))
    return fusion.fuse_color_images(pairs, mode, method, levels or (1 if method == "wavelet" else None), order)


def fuse_folder(spark: SparkSession, root: str, out: str | None, mode: str = "ycbcr", method: str = "wavelet", grey: str | None = None, colour: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Fuse all pairs of a data set and write them as PNG files to ``out`` (None: write nothing); (fused rows, skip report).

    Which source is grey is a parameter; without it the first folder by name is.
    """
    images = raster.read_images(spark, root)
    if grey is None or colour is None:
        grey, colour = raster.source_roles(images)
    pairs, skipped = pair_by_name(raster.grey_images(images.where(F.col("role") == grey)), raster.colour_images(images.where(F.col("role") == colour)))
    fused = fuse_pairs(pairs, mode, method)
    if out:
        stem = F.regexp_replace("img", r"\.[^.]*$", "")
        rows = fused if mode == "grayscale" else fused.select("img", "h", "w", F.flatten(F.transform(F.arrays_zip("red", "green", "blue"), lambda z: F.array(*[z[c].cast("double") for c in ("red", "green", "blue")]))).alias("fused"))
        files.write_files(files.encoded(rows.withColumn("img", stem)), out)
    return fused, skipped


def evaluation_rows(spark: SparkSession, root: str, fused_root: str) -> tuple[DataFrame, DataFrame]:
    """(rows, report): (Model, ImageName, h, w, a, b, f) of every fused image whose two sources are there, and (Model, ImageName) of the others.

    Fused images stand in ``fused_root``/method; all images are made grey.
    """
    images = raster.read_images(spark, root)
    one, two = raster.source_roles(images)
    side = lambda role, name: raster.grey_images(images.where(F.col("role") == role)).select("img", "h", "w", F.col("px").alias(name))
    found = raster.read_images(spark, fused_root).where(~F.col("role").startswith("."))
    if found.isEmpty():
        raise ValueError(f"no folder of a method with images is in {fused_root!r}")
    fused = raster.grey_images(found).select(F.col("role").alias("Model"), "img", "h", "w", F.col("px").alias("f"))
    sources = side(one, "a").join(side(two, "b"), ["img", "h", "w"])
    rows = fused.join(sources, ["img", "h", "w"]).select("Model", F.col("img").alias("ImageName"), "h", "w", "a", "b", "f")
    return rows, fused.join(sources, ["img", "h", "w"], "left_anti").select("Model", F.col("img").alias("ImageName"))


def evaluate_folders(spark: SparkSession, root: str, fused_root: str, out: str, windows: tuple[str, ...] = E.WINDOWED) -> DataFrame:
    """Score all methods and write a CSV table for each (AVERAGE last) and a summary; the skip report is returned."""
    rows, skipped = evaluation_rows(spark, root, fused_root)
    scores = E.evaluate(rows, windows=windows)
    report.write_reports(scores, [c for c in E.COLUMNS if c in scores.columns], out)
    return skipped
