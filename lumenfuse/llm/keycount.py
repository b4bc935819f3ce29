"""How often each 32-bit key of a hash occurs in the whole corpus, by one compact shuffle.

Map tasks sort their keys and send them as differences of two bytes; each reducer owns a range of keys and
returns (a) its part of a bitmap of the keys that occur at least twice and (b) the counts of frequent keys.
The bitmap has a fixed largest size and the list of frequent keys a fixed largest length, so what is
broadcast is bounded whatever the corpus.  Both only *order or skip* work: a bit set by chance costs time,
never a result, because a key that truly repeats always has its bit set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfuse.llm.common import give_back, lean, materialize

FLUSH = 2_000_000
#: Counts above this may enter the list of frequent keys, which holds at most MAX_FREQUENT keys.
FREQUENT_FROM, MAX_FREQUENT = 8, 1 << 20
MIN_BITS, MAX_BITS = 20, 28


def pack(keys: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted distinct uint32 keys as two-byte differences; larger steps go to a second list."""
    step = np.diff(keys, prepend=np.uint32(0))
    far = step >= 65535
    return np.where(far, 65535, step).astype(np.uint16).tobytes(), step[far].tobytes()


def unpack(near: bytes, far: bytes) -> np.ndarray:
    step = np.frombuffer(near, np.uint16).astype(np.uint32)
    step[step == 65535] = np.frombuffer(far, np.uint32)
    return np.cumsum(step, dtype=np.uint32)


@dataclass
class KeyCounts:
    """What tasks get: bitmaps by kind, and the frequent keys in order with their counts."""

    bits: int
    maps: dict[int, np.ndarray]
    keys: np.ndarray
    counts: np.ndarray

    def repeated(self, hashes: np.ndarray, kind: int = 0) -> np.ndarray:
        at = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        return (self.maps[kind][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def frequency(self, hashes: np.ndarray) -> np.ndarray:
        """Count of the frequent ones, 0 for others."""
        k = (hashes >> np.uint64(32)).astype(np.uint32)
        if not len(self.keys):
            return np.zeros(len(k), np.int64)
        i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[i] == k, self.counts[i], 0)


def count_keys(rows: DataFrame, hashes_of: Callable[[Iterator[pa.RecordBatch]], Iterator[list[np.ndarray]]], kinds: int = 1) -> KeyCounts:
    """``hashes_of`` turns the batches of a task into lists of hash arrays, one array for each kind.

    Kind 0 has all occurrences.  Further kinds are marks: their bitmaps hold keys that have the mark and
    occur at least twice among kind 0.
    """
    spark = rows.sparkSession
    bits = int(min(MAX_BITS, max(MIN_BITS, np.ceil(np.log2(max(1, rows.count()) * 1024)))))
    parts_log = int(min(16, max(3, np.ceil(np.log2(4 * max(1, rows.rdd.getNumPartitions()))))))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in range(kinds)]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind, arrays in enumerate(held):
                if not arrays:
                    continue
                keys, n = np.unique(np.concatenate(arrays), return_counts=True)
                cut = np.searchsorted(keys, (np.arange(1 << parts_log, dtype=np.uint64) << np.uint64(32 - parts_log)).astype(np.uint32))
                cut = np.append(cut, len(keys))
                out = []
                for p in range(1 << parts_log):
                    k, c = keys[cut[p] : cut[p + 1]], n[cut[p] : cut[p + 1]]
                    if len(k):
                        more = np.flatnonzero(c > 1)
                        out.append((p, kind, *pack(k), more.astype(np.uint32).tobytes(), c[more].astype(np.int64).tobytes()))
                arrays.clear()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "kind", "near", "far", "many_at", "many"])

        for lists in hashes_of(batches):
            for kind, h in enumerate(lists):
                held[kind].append((h >> np.uint64(32)).astype(np.uint32))
            size += len(lists[0])
            if size >= FLUSH:
                yield from flush()
                size = 0
        yield from flush()

    def gather(t: pa.Table) -> pa.Table:
        part = t.column("part")[0].as_py()
        by_kind: list[tuple[list, list]] = [([], []) for _ in range(kinds)]
        for r in t.to_pylist():
            k = unpack(r["near"], r["far"])
            c = np.ones(len(k), np.int64)
            c[np.frombuffer(r["many_at"], np.uint32)] = np.frombuffer(r["many"], np.int64)
            by_kind[r["kind"]][0].append(k)
            by_kind[r["kind"]][1].append(c)
        keys, counts = np.concatenate(by_kind[0][0]), np.concatenate(by_kind[0][1])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=keys[0] ^ np.uint32(1)))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        often = keys[counts >= 2]
        maps = []
        for kind in range(kinds):
            mine = often if kind == 0 else np.intersect1d(often, np.concatenate(by_kind[kind][0]) if by_kind[kind][0] else np.empty(0, np.uint32))
            bitmap = np.zeros(1 << (bits - parts_log), np.uint8)
            bitmap[(mine >> np.uint32(32 - bits)).astype(np.int64) - (part << (bits - parts_log))] = 1
            maps.append(np.packbits(bitmap, bitorder="little").tobytes())
        top = counts > FREQUENT_FROM
        level = np.minimum(4 * np.log2(counts[top] / FREQUENT_FROM), 255).astype(np.int64)
        del t, by_kind
        give_back()
        return pa.table({"part": pa.array([part], pa.int32()), "maps": pa.array([maps], pa.list_(pa.binary())), "keys": pa.array([keys[top].tobytes()], pa.binary()), "counts": pa.array([counts[top].tobytes()], pa.binary()), "levels": pa.array([np.bincount(level, minlength=256)], pa.list_(pa.int64()))})

    sent = rows.mapInArrow(lean(send), "part int, kind int, near binary, far binary, many_at binary, many binary")
    got = materialize(sent.groupBy("part").applyInArrow(gather, "part int, maps array<binary>, keys binary, counts binary, levels array<long>"))
    # 256 sums, then the cut that keeps the list within its bound
    levels = np.zeros(256, np.int64)
    for r in got.select(F.posexplode("levels").alias("i", "n")).groupBy("i").agg(F.sum("n").alias("n")).collect():
        levels[r["i"]] = r["n"]
    above = np.cumsum(levels[::-1])[::-1]
    cut = int(np.argmax(above <= MAX_FREQUENT)) if (above <= MAX_FREQUENT).any() else 256

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                k, c = np.frombuffer(r["keys"], np.uint32), np.frombuffer(r["counts"], np.int64)
                keep = np.minimum(4 * np.log2(np.maximum(c, 1) / FREQUENT_FROM), 255).astype(np.int64) >= cut
                yield pa.RecordBatch.from_arrays([pa.array([k[keep].tobytes()], pa.binary()), pa.array([c[keep].tobytes()], pa.binary())], names=["keys", "counts"])

    # bounded: MAX_FREQUENT keys, and kinds bitmaps of at most 2**MAX_BITS bits
    top = got.select("keys", "counts").mapInArrow(frequent, "keys binary, counts binary").toArrow().to_pylist()
    keys = np.concatenate([np.frombuffer(r["keys"], np.uint32) for r in top]) if top else np.empty(0, np.uint32)
    counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in top]) if top else np.empty(0, np.int64)
    order = np.argsort(keys)
    whole = {kind: np.zeros(1 << (bits - 3), np.uint8) for kind in range(kinds)}
    width = 1 << (bits - parts_log - 3)
    for kind in range(kinds):
        for r in got.select("part", F.element_at("maps", kind + 1).alias("m")).toArrow().to_pylist():
            whole[kind][r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["m"], np.uint8)
    return KeyCounts(bits, whole, keys[order], counts[order])
