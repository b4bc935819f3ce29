"""Image statistics: moments, histograms of a bin width, block aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def image_stats(pix: DataFrame, v: str = "f") -> DataFrame:
    """Range, mean, sample variance, skewness and (non-excess) kurtosis over sample variance, by image; two passes, one small join."""
    base = pix.groupBy("img").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"))
    d = F.col(v) - F.col("mean")
    third = pix.join(base, "img").groupBy("img").agg(F.avg(d * d * d).alias("m3"), F.avg(d * d * d * d).alias("m4"))
    positive = F.nullif("var", F.lit(0.0))
    return base.join(third, "img").select("img", "lo", "hi", "mean", "var", (F.col("m3") / F.pow(positive, F.lit(1.5))).alias("skew"), (F.col("m4") / (positive * positive)).alias("kurt"))


def histogram(pix: DataFrame, v: str, width: float, origin: float = 0.0) -> DataFrame:
    """Counts of bins of ``width`` centred on origin + k * width."""
    k = F.floor((F.col(v) - origin) / width + 0.5)
    return pix.groupBy("img", (k * width + origin).alias("centre")).agg(F.count(F.lit(1)).alias("n"))


def block_mean(pix: DataFrame, v: str, size: int = 16) -> DataFrame:
    """Mean of each size x size block; blocks over the border count as if filled with zeros."""
    return pix.groupBy("img", F.floor(F.col("r") / size).cast("int").alias("R"), F.floor(F.col("c") / size).cast("int").alias("C")).agg((F.sum(v) / (size * size)).alias("mean"))


def channel_stats(pix: DataFrame, *channels: str) -> DataFrame:
    """Min, max, mean and population deviation of each channel, by image."""
    return pix.groupBy("img").agg(*[g(c).alias(f"{n}_{c}") for c in channels for n, g in (("min", F.min), ("max", F.max), ("mean", F.avg), ("sd", F.stddev_pop))])


def sample_pixels(pix: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The same n pixels (r, c) of each image on every run, all of a smaller image: those of the smallest hashes.

    Hashes are counted in 4096 ranges first, so only the range at the n-th hash and those below it are numbered, each in a window of its own; no image is sorted whole.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in ("img", "r", "c")]))
    keyed = pix.withColumn("_key", key).withColumn("_range", F.substring("_key", 1, 3))
    upto = W.partitionBy("img").orderBy("_range")
    counts = keyed.groupBy("img", "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.sum("_n").over(upto) - F.col("_n")).where(F.col("_before") < n)
    nth = F.row_number().over(W.partitionBy("img", "_range").orderBy("_key", "r", "c"))
    return keyed.join(counts.drop("_n"), ["img", "_range"]).withColumn("_k", nth + F.col("_before")).where(F.col("_k") <= n).select(*pix.columns)


def sample_union(pix: DataFrame, total: int, seed: int = 42) -> DataFrame:
    """A sample of all images together: ``total`` pixels shared out evenly, at least one an image."""
    images = pix.select("img").distinct().count()
    return sample_pixels(pix, max(1, total // max(images, 1)), seed)
