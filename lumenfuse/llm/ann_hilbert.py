"""Approximate nearest neighbours by shifted space-filling curves.

1. CURVES Hilbert curves run through random projections (DIMS dimensions, BITS bits each) of the vectors.  Spark
   range-partitions and sorts all curves at once, which gives every vector a rank on each.
2. A query looks at the windows around its own place and around the places of its PROBES - 1 cheapest shifts: mirror
   images in those halving planes that it lies nearest to, where a neighbour is most likely to be on the other side.
   Ranks are cut into buckets of one window's length, so windows and curve meet in an equi-join that Spark splits
   like any other; no group is gathered.
3. The windows of all curves merge.  Exact distances to the NEAR_PROBES first windows bound a query's k-th distance from
   above; of the other windows those vectors go on whose angle to the query, estimated from 512 sign bits, may be within that bound (a vector
   just at the bound passes with a probability of 99.4 %, a nearer one with more).
4. What is left is reranked by exact distance on the original vectors.

A window holds ceil(FACTOR * n**POWER) vectors on each side (n: vectors of the table), so the share of the table that a
query looks at falls as the table grows; its own windows hold at least k + 1 on each side, so tables of up to k + 1 vectors are
searched whole.  Nothing else depends on the size.

Equal vectors are one point of the curves, so a group of copies of any size cannot crowd a window out; of
its ids the k + 1 smallest are carried, which is exact, because ties go to smaller ids.

Edge cases: vectors that are null, zero or hold null or non-finite components take no part, as query or
as candidate; vectors of different length are not compared; fewer than k candidates give all; a query
without candidates has no rows; a null vec_id takes no part; repeated rows (same id and vector) count once; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from lumenfuse.llm.common import checked_broadcast, materialize
from lumenfuse.llm.vectors import hilbert_index, matrix, valid_vectors

CURVES, DIMS, BITS, PROBES, NEAR_PROBES = 32, 12, 4, 32, 4
FACTOR, POWER, SLACK, SEED = 0.013, 0.6, 2.5, 20240
#: Halving planes of which sets are mirrored; 64-bit words of a sketch.
PLANES, WORDS = 8, 8


def projections(dim: int, curves: int, dims: int, seed: int) -> np.ndarray:
    """(curves, dim, dims): orthonormal directions of each curve."""
    rng = np.random.default_rng([seed, dim])
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dims)))[0][:, :dims] for _ in range(curves)])


def curve_keys(p: np.ndarray, bits: int) -> np.ndarray:
    """Place on a curve of projected vectors (of deviation about 1); what lies beyond 3 is at the rim."""
    return hilbert_index(np.clip(np.floor((p + 3) / 6 * (1 << bits)), 0, (1 << bits) - 1), bits)


def sketches(x: np.ndarray, seed: int) -> np.ndarray:
    """(rows, WORDS): signs of random projections, as 64-bit words."""
    g = np.random.default_rng([seed, 7, x.shape[1]]).standard_normal((x.shape[1], 64 * WORDS))
    return np.packbits(x @ g > 0, axis=1).view(np.int64)


def shifted(p: np.ndarray, probes: int) -> np.ndarray:
    """(rows, probes, dims): the points themselves, then their mirror images, cheapest sets of planes first."""
    m = min(p.shape[1], PLANES)
    sets = (np.arange(1 << m)[:, None] >> np.arange(m)) & 1
    near = np.argsort(np.abs(p), axis=1)[:, :m]
    cost = np.take_along_axis(p, near, 1) ** 2 @ sets.T
    best = np.argsort(cost, axis=1, kind="stable")[:, : min(probes, 1 << m)]
    sign = np.ones((*best.shape, p.shape[1]))
    np.put_along_axis(sign, np.broadcast_to(near[:, None, :], (*best.shape, m)), 1.0 - 2 * sets[best], 2)
    return p[:, None, :] * sign


def _places(points: DataFrame, queries: DataFrame, curves: int, dims: int, probes: int, seed: int) -> DataFrame:
    """(dim, curve, key, probe, point): every point on every curve (probe -1) and every probe of a query; a point's own place is probe 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of = {c: b.column(b.schema.get_field_index(c)) for c in ("dim", "scale", "asks", "point", "v")}
            dim, asks = of["dim"].to_numpy(), of["asks"].to_numpy(zero_copy_only=False)
            for d in np.unique(dim).tolist():
                mine = dim == d
                for ask in (False, True):
                    at = pa.array(mine & (asks == ask))
                    point = of["point"].filter(at)
                    if not len(point):
                        continue
                    x = matrix(of["v"].filter(at)) / of["scale"].filter(at).to_numpy()[:, None] * math.sqrt(d)
                    for c, g in enumerate(projections(d, curves, min(dims, d), seed)):
                        p = x @ g
                        p = shifted(p, probes) if ask else p[:, None, :]
                        n, k = p.shape[:2]
                        probe = np.tile(np.arange(k) if ask else [-1], n).astype(np.int32)
                        keys = curve_keys(p.reshape(n * k, -1), BITS)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n * k, d, np.int32)), pa.array(np.full(n * k, c, np.int32)), pa.array(keys), pa.array(probe), point.take(pa.array(np.repeat(np.arange(n), k)))], names=["dim", "curve", "key", "probe", "point"])

    cols = ("dim", "scale", "point", "v")
    both = points.select(*cols, F.lit(False).alias("asks")).union(queries.select(*cols, F.lit(True).alias("asks")))
    return both.mapInArrow(run, "dim int, curve int, key long, probe int, point long")


def _ranked(places: DataFrame, parts: int) -> DataFrame:
    """(dim, curve, probe, point, rank): how many points come before each place on its curve; written."""
    ranged = places.repartitionByRange(parts, "dim", "curve", "key", "probe", "point").sortWithinPartitions("dim", "curve", "key", "probe", "point").withColumn("_part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on, seen = None, 0
        for b in batches:
            line = [b.column(b.schema.get_field_index(c)).to_numpy() for c in ("dim", "curve")]
            own = (b.column(b.schema.get_field_index("probe")).to_numpy() < 0).astype(np.int64)
            new = np.flatnonzero((np.diff(line[0], prepend=line[0][:1] - 1) != 0) | (np.diff(line[1], prepend=line[1][:1] - 1) != 0))
            rank = np.empty(len(own), np.int64)
            for a, z in zip(new.tolist(), [*new[1:].tolist(), len(own)]):
                if (this := (line[0][a], line[1][a])) != on:
                    on, seen = this, 0
                rank[a:z] = seen + np.cumsum(own[a:z]) - own[a:z]
                seen += int(own[a:z].sum())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in ("dim", "curve", "probe", "point", "_part")), pa.array(rank)], names=["dim", "curve", "probe", "point", "_part", "rank"])

    within = materialize(ranged.mapInArrow(run, "dim int, curve int, probe int, point long, _part int, rank long"))
    sizes = within.groupBy("dim", "curve", "_part").agg(F.count(F.when(F.col("probe") < 0, 1)).alias("n"))  # partitions times curves times lengths
    before = sizes.select("dim", "curve", "_part", F.coalesce(F.sum("n").over(W.partitionBy("dim", "curve").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy("dim", "curve")).alias("points"))
    return within.join(checked_broadcast(materialize(before)), ["dim", "curve", "_part"]).select("dim", "curve", "probe", "point", (F.col("rank") + F.col("before")).alias("rank"), "points")


def windows(points: DataFrame, queries: DataFrame, k: int, factor: float, curves: int, dims: int, probes: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The curves, (found, rank) by bucket, and the windows on them, (asked, first, low, high) by bucket; ``first`` marks the NEAR_PROBES first of a query."""
    parts = max(8, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranks = _ranked(_places(points, queries, curves, dims, probes, seed), parts)
    ranks = materialize(ranks.withColumn("width", F.ceil(F.pow(F.col("points"), F.lit(POWER)) * factor)))
    bucket = F.greatest(F.col("width"), F.lit(k + 1))
    half = F.when(F.col("probe") == 0, bucket).otherwise(F.col("width"))
    homes = ranks.where("probe < 0").select("dim", "curve", F.floor(F.col("rank") / bucket).alias("bucket"), "rank", F.col("point").alias("found"))
    asks = ranks.where("probe >= 0").select("dim", "curve", F.col("point").alias("asked"), (F.col("probe") < NEAR_PROBES).alias("first"), (F.col("rank") - half).alias("low"), (F.col("rank") + half).alias("high"), bucket.alias("_b"), "points")
    reach = F.sequence(F.floor(F.greatest(F.col("low"), F.lit(0)) / F.col("_b")), F.floor((F.least("high", "points") - 1) / F.col("_b")))
    return homes, asks.select("dim", "curve", "asked", "first", "low", "high", F.explode(reach).alias("bucket"))


def members(homes: DataFrame, asks: DataFrame) -> DataFrame:
    """Who is in which window: (asked, found, ...), once for each window."""
    return homes.join(asks, ["dim", "curve", "bucket"]).where("rank >= low and rank < high and found <> asked").drop("dim", "curve", "bucket", "rank", "low", "high", "first")


def _distances(pairs: DataFrame, points: DataFrame, queries: DataFrame) -> DataFrame:
    """(asked, found, score): Euclidean distance of each pair, once."""
    q = queries.select(F.col("point").alias("asked"), F.col("v").alias("q"))
    both = pairs.select("asked", "found").distinct().join(points.select(F.col("point").alias("found"), "v"), "found").join(checked_broadcast(q), "asked")
    total = F.aggregate(F.zip_with("v", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return both.select("asked", "found", F.sqrt(total).alias("score"))


def nearest(embeddings: DataFrame, is_query: Column, k: int = 10, factor: float = FACTOR, curves: int = CURVES, dims: int = DIMS, probes: int = PROBES, seed: int = SEED) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row where ``is_query`` (a condition on vec_id)."""
    rows = valid_vectors(embeddings).withColumn("dim", F.size("v"))
    # points: distinct vectors; of the ids of each the k + 1 smallest
    w = W.partitionBy("v").orderBy("vec_id")
    few = rows.distinct().withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    points = few.groupBy("v", "dim").agg(F.min("vec_id").alias("point"), F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("norm", norm)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dim, out = b.column(b.schema.get_field_index("dim")).to_numpy(), np.zeros((b.num_rows, WORDS), np.int64)
            for d in np.unique(dim).tolist():
                out[dim == d] = sketches(matrix(b.column(b.schema.get_field_index("v")).filter(pa.array(dim == d))), seed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(out), pa.list_(pa.int64()))], names=[*b.schema.names, "sketch"])

    kind = T.StructType([*points.schema.fields, T.StructField("sketch", T.ArrayType(T.LongType()))])
    points = materialize(points.mapInArrow(sketched, kind))
    # the scale of the curves: half of the vectors of a length are no longer than this
    scale = materialize(points.groupBy("dim").agg(F.percentile_approx("norm", 0.5).alias("scale")))
    asked = materialize(rows.where(is_query).select("vec_id", "v").distinct().join(points.select("v", "point"), "v").select(F.col("vec_id").alias("query_id"), "point"))
    scaled = points.join(checked_broadcast(scale), "dim")
    queries = materialize(scaled.join(checked_broadcast(materialize(asked.select("point").distinct())), "point", "left_semi"))
    homes, asks = windows(scaled, queries, k, factor, curves, dims, probes, seed)
    own = materialize(_distances(members(homes, asks.where("first")), points, queries))
    kth = own.withColumn("_r", F.row_number().over(W.partitionBy("asked").orderBy("score"))).where(F.col("_r") <= k).groupBy("asked").agg(F.max("score").alias("bound"), F.count(F.lit(1)).alias("n"))
    about = queries.select(F.col("point").alias("asked"), F.col("norm").alias("qn"), F.col("sketch").alias("qs")).join(kth.where(F.col("n") == k).select("asked", "bound"), "asked", "left")
    cosine = (F.col("qn") * F.col("qn") + F.col("norm") * F.col("norm") - F.col("bound") * F.col("bound")) / (2 * F.col("qn") * F.col("norm"))
    share = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) / math.pi
    bits = 64 * WORDS
    most = bits * share + SLACK * F.sqrt(bits * share * (1 - share))
    apart = sum((F.bit_count(F.col("sketch")[i].bitwiseXOR(F.col("qs")[i])) for i in range(WORDS)), F.lit(0))
    sketched_homes = homes.join(points.select(F.col("point").alias("found"), "norm", "sketch"), "found")
    rest = members(sketched_homes, asks.where("not first")).join(checked_broadcast(materialize(about)), "asked").where(F.col("bound").isNull() | ((cosine <= 1) & (apart <= most)))
    rest = materialize(rest.select("asked", "found").distinct()).join(own.select("asked", "found"), ["asked", "found"], "left_anti")
    best = own.union(_distances(rest, points, queries)).union(queries.select(F.col("point").alias("asked"), F.col("point").alias("found"), F.lit(0.0)))
    best = best.withColumn("_r", F.row_number().over(W.partitionBy("asked").orderBy("score", "found"))).where(F.col("_r") <= k + 1)
    named = asked.join(best, asked["point"] == best["asked"]).join(points.select(F.col("point").alias("found"), "ids"), "found")
    cand = named.select("query_id", "score", F.explode("ids").alias("vec_id")).where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = cand.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
