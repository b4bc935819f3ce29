"""SHA-256 of many rows by key, in order, without ever holding a key's rows together."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfuse.llm.common import lean


def ordered_sha256(rows: DataFrame, key: str, order: str, piece: Column, separator: str, name: str = "sha256") -> DataFrame:
    """(key, name): lowercase hex digest of the pieces of each key in ascending order, joined by ``separator``.

    Rows are hash-partitioned and sorted by Spark, which spills; a task streams them through one digest.  The digest of one
    key is sequential by its definition, so a hot key takes one task long, but no memory.  A null key is a key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, begun, sep = None, hashlib.sha256(), False, separator.encode()
        for b in batches:
            keys, pieces = b.column(0), b.column(1)
            done: list = []
            for k, p in zip(keys.to_pylist(), pieces.to_pylist()):
                if begun and k == now:
                    digest.update(sep)
                else:
                    if begun:
                        done.append((now, digest.hexdigest()))
                    now, digest, begun = k, hashlib.sha256(), True
                digest.update(p)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], keys.type), pa.array([h for _, h in done], pa.string())], names=[key, name])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([now], keys.type), pa.array([digest.hexdigest()], pa.string())], names=[key, name])

    sent = rows.select(F.col(key), F.col(order).alias("_order"), F.coalesce(piece.cast("string"), F.lit("")).cast("binary").alias("_piece"))
    ready = sent.repartition(F.col(key)).sortWithinPartitions(key, "_order").select(key, "_piece")
    return ready.mapInArrow(lean(run), f"{key} {rows.schema[key].dataType.simpleString()}, {name} string")
