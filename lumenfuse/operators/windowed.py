"""Scores of image rows by name: window metrics as relations (``similarity``), feature, contrast and order metrics (``perceptual``) by NumPy on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lumenfuse.operators import arrays, perceptual, similarity

METRICS = (*similarity.METRICS, *perceptual.METRICS)
#: Shortest side that the windows of an array metric fit into.
MIN_SIDE = {"FMI": 3, "FMI_none": 3, "FMI_gradient": 3, "FMI_dct": 3}


def score(images: DataFrame, *names: str) -> DataFrame:
    """(img, names...) for image rows (img, h, w, a, b, f), one row an image; a metric that an image is too small for is null."""
    if unknown := set(names) - set(METRICS):
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    native = [n for n in names if n in similarity.METRICS]
    by_array = [n for n in names if n not in native]
    if not by_array:
        return similarity.score(images, *native)
    scores = _array_scores(images, by_array)
    return similarity.score(images, *native).join(scores, "img").select("img", *names) if native else scores


def _array_scores(images: DataFrame, names: list[str]) -> DataFrame:
    """Image rows are spread by Spark; a task holds one image at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[perceptual.METRICS[n](a, b, f) if min(a.shape) >= MIN_SIDE.get(n, 1) else None for n in names] for a, b, f in arrays.images(batch, "a", "b", "f")]
            scores = zip(*out) if out else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("img")), *[pa.array(x, pa.float64()) for x in scores]], names=["img", *names])

    return images.select("img", "h", "w", "a", "b", "f").mapInArrow(run, f"img {images.schema['img'].dataType.simpleString()}, " + ", ".join(f"{n} double" for n in names))
