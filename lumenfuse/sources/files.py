"""Image files: PGM in and out, PNG out.  Files are encoded and written by tasks, one image at a time."""

from __future__ import annotations

import re
import struct
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfuse.operators import arrays

_HEADER = re.compile(rb"(P[25])(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)(?:\s+|#[^\n]*\n)+(\d+)\s")


def decode_pgm(data: bytes) -> np.ndarray | None:
    """Grey levels of a P2 or P5 file; what a cut-off file lacks is zero; None if it is no PGM file."""
    head = _HEADER.match(data)
    if not head:
        return None
    w, h, top = (int(head[i]) for i in (2, 3, 4))
    body = data[head.end() :]
    if head[1] == b"P2":
        got = np.array(re.sub(rb"#[^\n]*", b"", body).split()[: w * h], float)
    else:
        kind = np.dtype(">u2") if top > 255 else np.dtype(np.uint8)
        got = np.frombuffer(body[: min(len(body) // kind.itemsize, w * h) * kind.itemsize], kind).astype(float)
    if len(got) < w * h:
        warnings.warn(f"PGM file with {len(got)} of {w * h} pixels", stacklevel=2)
    return np.pad(got, (0, w * h - len(got))).reshape(h, w)


def catalogue(spark: SparkSession, *folders: str, kinds: tuple[str, ...] = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")) -> DataFrame:
    """(path, name, kind, bytes) of the image files below folders, in order of their paths; one row a path, endings in any case of letters.

    Only names are read, no file is opened.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(folders))
    name = F.element_at(F.split("path", "/"), -1)
    found = raw.select("path", name.alias("name"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)).alias("kind"), F.col("length").alias("bytes"))
    return found.where(F.col("kind").isin(*kinds)).dropDuplicates(["path"]).orderBy("path")


def read_pgm(spark: SparkSession, path: str, glob: str = "*.pgm") -> DataFrame:
    """(path, h, w, px) of the PGM files below a folder; other files are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [decode_pgm(c.as_py()) for c in batch.column(1)]
            some = [i for i, x in enumerate(read) if x is not None]
            size = [pa.array([read[i].shape[k] for i in some], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some, pa.int64())), *size, arrays.list_column([read[i] for i in some])], names=["path", "h", "w", "px"])

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return raw.select("path", "content").mapInArrow(run, "path string, h int, w int, px array<double>")


def _percentiles(x: np.ndarray, shares: tuple[float, ...], bins: int = 101) -> list[float]:
    """Percentiles inside bins about the mean, from straight lines between the bins' edges."""
    width, middle = float(x.max() - x.min()) / bins, float(x.mean())
    if not width:
        return [middle] * len(shares)
    z = (x.ravel() - middle) / width
    k, n = np.unique(np.copysign(np.floor(np.abs(z) + 0.5), z), return_counts=True)
    upto = np.cumsum(n)
    at = [int(np.searchsorted(upto, share * x.size)) for share in shares]
    return [float(middle + width * (k[i] - 0.5 + (share * x.size - upto[i] + n[i]) / n[i])) for i, share in zip(at, shares)]


def level_range(x: np.ndarray, kind: str | tuple[float, float]) -> tuple[float, float]:
    """Values that become black and white: given, ``auto`` (least and largest), ``auto2`` (two deviations about the mean) or ``auto3``.

    ``auto3`` moves the 10th and 90th percentile, read off 101 bins as ``points.percentile_range`` does, apart by a quarter of their distance.
    """
    if kind == "auto":
        lo, hi = float(x.min()), float(x.max())
    elif kind == "auto2":
        dev = float(x.std(ddof=1)) if x.size > 1 else 0.0
        lo, hi = float(x.mean()) - 2 * dev, float(x.mean()) + 2 * dev
    elif kind == "auto3":
        p, q = _percentiles(x, (0.1, 0.9))
        lo, hi = p - (q - p) / 8, q + (q - p) / 8
    elif isinstance(kind, str):
        raise KeyError(f"unknown range {kind!r}")
    else:
        lo, hi = kind
    return (lo, hi) if hi - lo > np.finfo(float).eps else (lo - 0.5, lo + 0.5)


def to_levels(x: np.ndarray, kind: str | tuple[float, float]) -> np.ndarray:
    lo, hi = level_range(x, kind)
    return np.clip(np.floor((x - lo) * (255 / (hi - lo)) + 0.5), 0, 255).astype(np.uint8)


def encode_pgm(x: np.ndarray, ascii_body: bool = False, comment: str = "") -> bytes:
    note = b"".join(b"# " + line.encode() + b"\n" for line in comment.splitlines())
    head = (b"P2\n" if ascii_body else b"P5\n") + note + f"{x.shape[1]} {x.shape[0]}\n255\n".encode()
    return head + ("\n".join(" ".join(map(str, row)) for row in x.tolist()).encode() + b"\n" if ascii_body else x.tobytes())


def encode_png(x: np.ndarray) -> bytes:
    """Eight-bit PNG of (h, w) grey or (h, w, 3) red-green-blue levels."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = np.concatenate([np.zeros((x.shape[0], 1), np.uint8), x.reshape(x.shape[0], -1)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, 2 if x.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def encoded(images: DataFrame, kind: str = "png", levels: str | tuple[float, float] = (0.0, 255.0), channel: str = "fused") -> DataFrame:
    """(name, data) from image rows (img, h, w, channel); a channel of 3 h w values is red, green, blue by pixel (PNG only)."""
    if kind not in ("png", "pgm", "pgm-ascii"):
        raise ValueError(f"unknown kind {kind!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda k: batch.column(batch.schema.get_field_index(k))  # noqa: B023, E731
            data = []
            for h, w, x in zip(col("h").to_pylist(), col("w").to_pylist(), arrays.lists(col("px"))):
                x = to_levels(x.astype(float).reshape((h, w, 3) if x.size == 3 * h * w else (h, w)), levels)
                data.append(encode_png(x) if kind == "png" else encode_pgm(x, kind == "pgm-ascii"))
            yield pa.RecordBatch.from_arrays([pa.array([f"{i}.{kind[:3]}" for i in col("img").to_pylist()], pa.string()), pa.array(data, pa.binary())], names=["name", "data"])

    return images.select("img", "h", "w", F.col(channel).alias("px")).mapInArrow(run, "name string, data binary")


def write_files(files: DataFrame, folder: str) -> None:
    """One file per row of ``files(name, data)`` in a folder (a path or URI that all executors share).

    A task that runs again writes the same file again, under a name of its own until it is whole.
    """

    def write(rows: Iterator) -> None:
        import uuid

        from pyarrow import fs

        where, top = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("/") else (fs.LocalFileSystem(), folder)
        where.create_dir(top, recursive=True)
        for r in rows:
            part = f"{top}/.{r['name']}.{uuid.uuid4().hex}"
            with where.open_output_stream(part) as out:
                out.write(bytes(r["data"]))
            where.move(part, f"{top}/{r['name']}")

    files.select("name", "data").foreachPartition(write)
