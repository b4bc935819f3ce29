"""Shared pieces: tables in the cluster's shared folder, checked broadcasts, components, word hashes.

Lineage is cut by writing a Parquet table to the folder in ``spark.checkpoint.dir``; a lost executor then
costs a re-read.  Only in a local session without that setting (tests) a temporary folder stands in.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a one- or two-column table of numbers may be broadcast (a few MB in every executor for as long as its plan lives); above it a shuffle join runs.
BROADCAST_ROWS = 100_000
#: Bytes up to which the strings and arrays (16 bytes an entry) of such a table may be broadcast.
BROADCAST_BYTES = 4_000_000
#: Words hashed at once in a task.
CHUNK_WORDS = 200_000
#: Bytes of a text that are split into words at once; longer texts go piece by piece.
PIECE_BYTES = 2_000_000
#: ASCII white space: words are runs of anything else.
WHITE = " \t\n\x0b\f\r"

_own_dir: list[str] = []
_scratch: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local session without one gets a temporary folder, a cluster an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-llm-"))
    return _own_dir[0]


def remove_folder(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is materialized within is deleted at its end; what is to stay must be written before."""
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            remove_folder(spark, path)


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column is called so (in any case of letters)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def checked_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if the (written) table has at most ``limit`` rows and, where it has columns of open length, their values at most ``most_bytes``; otherwise Spark shuffles."""
    if df.limit(limit + 1).count() > limit:
        return df
    size = F.lit(0)
    for c, t in df.dtypes:
        if t in ("string", "binary"):
            size += F.coalesce(F.octet_length(f"`{c}`"), F.lit(0))
        elif t.startswith("array"):
            size += 16 * F.greatest(F.size(f"`{c}`"), F.lit(0))
    if any(t in ("string", "binary") or t.startswith("array") for _, t in df.dtypes) and (df.agg(F.sum(size)).first()[0] or 0) > most_bytes:
        return df
    return F.broadcast(df)


def give_back() -> None:
    """Hand memory that is free in this process back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; its worker gives memory back after each task, so a waiting worker holds little."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(src, dst)``; component is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al. 2014), each an aggregation with map-side
    combine and a join that AQE can split, so a hub of any degree is never gathered in one task.
    """
    spark = edges.sparkSession

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst"))).first()
        return tuple(r)

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("src", "dst").union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else e
        low = both.groupBy("src").agg(F.min("dst").alias("lo")).select("src", F.least("src", "lo").alias("lo"))
        joined = both.join(low, "src")
        if large:
            out = joined.where(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("lo").alias("dst"))
        else:
            out = joined.select(F.col("dst").alias("src"), F.col("lo").alias("dst")).union(low.select("src", F.col("lo").alias("dst")))
        return out.where(F.col("src") != F.col("dst")).distinct()

    cur = materialize(edges.where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    was = mark(cur)
    for _ in range(max_rounds):
        if not was[0]:
            break
        cur = materialize(star(star(cur, True), False))
        now = mark(cur)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select(F.col("dst").alias("node")).distinct()
    return cur.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots.select("node", F.col("node").alias("component")))


# ---------------------------------------------------------------- hashing of words and windows


class WordHash(dict):
    """The 128-bit hash of a word's bytes; keeps those of recent short words."""

    def __missing__(self, word: bytes) -> bytes:
        h = xxhash.xxh3_128_digest(word)
        if len(word) <= 48:
            if len(self) >= 100_000:
                self.clear()
            self[word] = h
        return h

    def of(self, text: bytes | None) -> np.ndarray:
        """(words, 2): both halves of the hash of each word of a text, which is split piece by piece."""
        if not text:
            return np.empty((0, 2), np.uint64)
        parts = [b"".join(map(self.__getitem__, piece.split())) for piece in pieces_of(text)]
        return np.frombuffer(b"".join(parts), np.uint64).reshape(-1, 2)


_GAP = re.compile(rb"[ \t\n\r\x0b\f]")


def pieces_of(text: bytes, most: int = PIECE_BYTES) -> Iterator[bytes]:
    """The text in pieces of about ``most`` bytes that end at white space, so that no word is cut."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > most and (gap := _GAP.search(text, at + most)):
            end = gap.start()
        yield text[at:end] if at or end < len(text) else text
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def window_hashes(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of w[i:i+k] for every i, built from windows of doubling length."""
    n = len(w) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc, cur, size, off = None, w, 1, 0
    while size <= k:
        if k & size:
            part = cur[off : off + n]
            acc = mix(part * _A + np.uint64(size)) if acc is None else mix(acc * _A + part * _B)
            off += size
        if 2 * size <= k:
            cur = mix(cur[:-size] * _B + cur[size:] * _A + np.uint64(2 * size + 1))
        size *= 2
    return acc


def word_slices(text: bytes, spans: list[tuple[int, int]]) -> list[bytes]:
    """The words of each span (first, end), in order of their start, joined by one space; the text is split piece by piece."""
    held: list[list[bytes]] = [[] for _ in spans]
    at, lo = 0, 0
    for piece in pieces_of(text):
        words = piece.split()
        end, i = at + len(words), lo
        while i < len(spans) and spans[i][0] < end:
            a, b = spans[i]
            if b > at:
                held[i].append(b" ".join(words[max(a - at, 0) : b - at]))
            elif i == lo:
                lo += 1
            i += 1
        at = end
    return [b" ".join(x for x in parts if x) for parts in held]


def chunks_of_words(batches: Iterator[pa.RecordBatch], text: str = "text", lower: bool = False) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, (words, 2) hashes of all their words, words of each row); a chunk ends after CHUNK_WORDS words.

    ``text`` is a binary column; a null has no words.  A row of more words is a chunk of its own.
    """
    cache = WordHash()
    for batch in batches:
        col, first, held, lens = batch.column(batch.schema.get_field_index(text)), 0, [], []
        for i in range(batch.num_rows):
            t = col[i].as_py()
            held.append(cache.of(t.lower() if lower and t is not None else t))
            lens.append(len(held[-1]))
            if sum(lens) >= CHUNK_WORDS or i + 1 == batch.num_rows:
                yield batch.slice(first, i + 1 - first), np.concatenate(held), np.array(lens, np.int64)
                first, held, lens = i + 1, [], []


def starts_of(lens: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lens)[:-1])) if len(lens) else np.zeros(0, np.int64)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
