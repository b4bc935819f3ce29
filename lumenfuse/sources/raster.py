"""Images as rows and as pixel relations.

``pairs(img, h, w, a, b)`` has one row per pair of images with row-major arrays; ``pixels`` explodes it.  Joins and
shuffles happen on image rows; the pixel relation inherits their partitioning by ``img``, so later
aggregations and windows inside an image need no further shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TILE = 8


def grey_levels(embedding: Column) -> Column:
    """Vector components as grey levels 0..255."""
    return F.transform(embedding, lambda e: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(e.cast("double") * 240 + 128).cast("int"))).cast("double"))


def tile_pairs(embeddings: DataFrame) -> DataFrame:
    """8 x 8 tiles, vector 2k with vector 2k + 1."""
    px = embeddings.select(F.floor(F.col("vec_id") / 2).alias("img"), (F.col("vec_id") % 2).alias("k"), grey_levels(F.col("embedding")).alias("px"))
    side = lambda k: F.any_value(F.when(F.col("k") == k, F.col("px")), True)
    both = px.groupBy("img").agg(side(0).alias("a"), side(1).alias("b")).where("a is not null and b is not null")
    return both.select("img", F.lit(TILE).alias("h"), F.lit(TILE).alias("w"), "a", "b")


def mosaic_pairs(embeddings: DataFrame) -> DataFrame:
    """64 x 64 mosaics of 64 tiles, mosaic 2k with mosaic 2k + 1; incomplete ones are left out."""
    px = embeddings.select(F.floor(F.col("vec_id") / 64).alias("m"), (F.col("vec_id") % 64).alias("t"), grey_levels(F.col("embedding")).alias("px"))
    rows = px.groupBy("m").agg(F.sort_array(F.collect_list(F.struct("t", "px"))).alias("tiles")).where(F.size("tiles") == 64)  # 64 tiles at most
    cell = lambda i: F.col("tiles")[F.floor(i / 512).cast("int") * 8 + F.floor(i % 64 / 8).cast("int")]["px"][F.floor(i % 512 / 64).cast("int") * 8 + (i % 8).cast("int")]
    whole = rows.select(F.floor(F.col("m") / 2).alias("img"), (F.col("m") % 2).alias("k"), F.transform(F.sequence(F.lit(0), F.lit(4095)), cell).alias("px"))
    side = lambda k: F.any_value(F.when(F.col("k") == k, F.col("px")), True)
    both = whole.groupBy("img").agg(side(0).alias("a"), side(1).alias("b")).where("a is not null and b is not null")
    return both.select("img", F.lit(64).alias("h"), F.lit(64).alias("w"), "a", "b")


def with_fused(pairs: DataFrame) -> DataFrame:
    """The pair and its fuzzy fusion f, the larger of both levels."""
    return pairs.withColumn("f", F.zip_with("a", "b", lambda a, b: F.greatest(a, b)))


def pixels(images: DataFrame, *channels: str) -> DataFrame:
    """(img, r, c, channels...) from image rows."""
    z = images.select("img", "w", F.posexplode(F.arrays_zip(*channels)).alias("p", "z"))
    return z.select("img", F.floor(F.col("p") / F.col("w")).cast("int").alias("r"), (F.col("p") % F.col("w")).cast("int").alias("c"), *[F.col(f"z.{x}").alias(x) for x in channels])


def image_rows(pix: DataFrame, *channels: str) -> DataFrame:
    """Image rows (img, h, w, channels...) from all pixels of each image."""
    cells = F.sort_array(F.collect_list(F.struct("r", "c", *channels)))  # one image
    rows = pix.groupBy("img").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"), cells.alias("x"))
    return rows.select("img", "h", "w", *[F.col(f"x.{k}").cast("array<double>").alias(k) for k in channels])


def read_images(spark: SparkSession, path: str, glob: str = "*.{png,jpg,jpeg,bmp,tif,tiff,PNG,JPG,JPEG,BMP,TIF,TIFF}") -> DataFrame:
    """Decoded images (dataset, role, img, h, w, channels, data), named by their last two folders; unreadable files are left out."""
    raw = spark.read.format("image").option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("dropInvalid", True).load(path)
    part = F.split(F.col("image.origin"), "/")
    return raw.select(F.element_at(part, -3).alias("dataset"), F.element_at(part, -2).alias("role"), F.element_at(part, -1).alias("img"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def _levels(images: DataFrame, to: Callable[[np.ndarray], list[np.ndarray]], names: tuple[str, ...]) -> DataFrame:
    """Image rows with the channels that ``to`` makes of (h, w, channels) bytes; other columns but ``data`` stay."""
    keep = [c for c in images.columns if c != "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {c: b.column(b.schema.get_field_index(c)) for c in (*keep, "data")}
            size = np.stack([col[c].to_numpy() for c in ("h", "w", "channels")], 1) if b.num_rows else np.empty((0, 3), int)
            out = [to(np.frombuffer(d.as_py(), np.uint8).reshape(shape)) for d, shape in zip(col["data"], size.tolist())]
            ends = np.concatenate(([0], np.cumsum(size[:, 0] * size[:, 1]))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x[k].ravel() for x in out]).astype(float) if out else np.empty(0))) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*(col[c] for c in keep), *lists], names=[*keep, *names])

    schema = T.StructType([*(images.schema[c] for c in keep), *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in names)])
    return images.mapInArrow(run, schema)


def grey_images(images: DataFrame, rule: str = "luma") -> DataFrame:
    """``read_images`` with grey levels ``px``: of coloured ones the rounded luma, or the mean of the channels (rule 'mean')."""
    if rule not in ("luma", "mean"):
        raise ValueError(f"unknown rule {rule!r}")

    def grey(x: np.ndarray) -> list[np.ndarray]:
        if x.shape[2] == 1:
            return [x[..., 0]]
        b, g, r = (x[..., k].astype(float) for k in range(3))  # Spark decodes to blue, green, red
        return [np.floor(0.2989 * r + 0.5870 * g + 0.1140 * b + 0.5) if rule == "luma" else (r + g + b) / 3]

    return _levels(images, grey, ("px",))


def colour_images(images: DataFrame) -> DataFrame:
    """``read_images`` with channels red, green, blue; a grey image has three equal ones."""
    return _levels(images, lambda x: [x[..., min(k, x.shape[2] - 1)] for k in (2, 1, 0)], ("red", "green", "blue"))


def to_scale(images: DataFrame, channel: str, full: float = 255.0) -> DataFrame:
    """Grey levels to 0..full (255 or 1): an image with nothing above 1 counts as 0..1 and is multiplied, another is divided."""
    top = F.array_max(channel)
    factor = F.when((top <= 1) & F.lit(full == 255.0), 255.0).when((top > 1) & F.lit(full == 1.0), 1 / 255.0).otherwise(1.0)
    return images.withColumn(channel, F.transform(channel, lambda v: v * factor))


def source_roles(images: DataFrame, fused: str = "FUSED", results: str = "eval_results") -> list[str]:
    """The two source folders of a data set, in order; folders of fused images and of results, and hidden ones, do not count."""
    role = F.col("role")
    found = images.where(~F.upper(role).contains(fused.upper()) & (role != results) & ~role.startswith(".")).select("role").distinct()
    names = sorted(r["role"] for r in found.limit(3).collect())
    if len(names) != 2:
        raise ValueError(f"two source folders are needed, found {names}")
    return names


def missing_sources(fused: DataFrame, sources: DataFrame) -> DataFrame:
    """Fused images whose sources are not there (the skip report)."""
    return fused.join(sources.select("img").distinct(), "img", "left_anti")
