"""Point operations and statistics over all values of an image: look-up tables, histogram matching, entropy, differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def look_up(x: Column, table: Sequence[float], origin: float = 0.0, step: float = 1.0) -> Column:
    """Linear interpolation in a table of values at origin, origin + step, ...; its ends are carried on in their direction."""
    if len(table) < 2:
        raise ValueError("a table has at least two values")
    values = F.array(*[F.lit(float(v)) for v in table])
    at = (x - origin) / step
    i = F.greatest(F.lit(0), F.least(F.floor(at), F.lit(len(table) - 2))).cast("int")
    low = F.get(values, i)
    return low + (at - i) * (F.get(values, i + 1) - low)


def point_op(pix: DataFrame, table: Sequence[float], origin: float = 0.0, step: float = 1.0, v: str = "v") -> DataFrame:
    return pix.withColumn(v, look_up(F.col(v).cast("double"), table, origin, step))


def _interpolated(x: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise linear through (xs, ys), xs increasing; x lies between the first and the last."""
    known = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in zip(xs, ys)])
    i = F.greatest(F.lit(0), F.least(F.size(F.filter(known, lambda k: k["x"] <= x)) - 1, F.lit(len(xs) - 2))).cast("int")
    a, b = F.get(known, i), F.get(known, i + 1)
    return a["y"] + (x - a["x"]) / (b["x"] - a["x"]) * (b["y"] - a["y"])


def match_histogram(pix: DataFrame, counts: Sequence[float], centres: Sequence[float], v: str = "v") -> DataFrame:
    """Values moved so that their histogram becomes ``counts`` at evenly spaced ``centres``; a constant image stays.

    The image's own distribution has as many bins as the wanted one, from its least to its largest value.
    """
    n = len(centres)
    if n < 2 or len(counts) != n:
        raise ValueError("at least two bins, and a count for each")
    full = [c + sum(counts) / n / 1e8 for c in counts]  # no bin quite empty
    width = centres[1] - centres[0]
    share = [sum(full[:k]) / sum(full) for k in range(n + 1)]
    edges = [centres[0] - width / 2, *[c + width / 2 for c in centres]]
    about = pix.groupBy("img").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(F.lit(1)).alias("size"))
    step = F.nullif((F.col("hi") - F.col("lo")) / n, F.lit(0.0))
    at = (F.col(v) - F.col("lo")) / step
    placed = pix.join(about, "img").withColumn("bin", F.when(F.col("hi") > F.col("lo"), F.least(F.floor(at), F.lit(n - 1))).cast("int"))
    have = placed.groupBy("img", "bin").agg(F.count(F.lit(1)).alias("k"), F.any_value("size").alias("size"))
    upto = F.sum("k").over(W.partitionBy("img").orderBy("bin"))
    ends = have.where("bin is not null").select("img", "bin", ((upto - F.col("k")) / F.col("size")).alias("below"), (upto / F.col("size")).alias("above"))
    moved = ends.select("img", "bin", _interpolated(F.col("below"), share, edges).alias("y0"), _interpolated(F.col("above"), share, edges).alias("y1"))
    part = (F.col(v) - F.col("lo")) / step - F.col("bin")
    out = placed.join(moved, ["img", "bin"], "left")
    return out.select(*[F.when(F.col("bin").isNull(), F.col(v)).otherwise(F.col("y0") + part * (F.col("y1") - F.col("y0"))).alias(c) if c == v else F.col(c) for c in pix.columns])


def centred_histogram(pix: DataFrame, v: str = "v", bins: float = 101, centre: str = "mean") -> DataFrame:
    """(img, centre, n): ``bins`` bins from least to largest value, one of them centred on the mean (or ``centre`` = 'zero'); a constant image has one."""
    if centre not in ("mean", "zero"):
        raise ValueError(f"unknown centre {centre!r}")
    about = pix.groupBy("img").agg(((F.max(v) - F.min(v)) / bins).cast("double").alias("width"), (F.avg(v) if centre == "mean" else F.lit(0.0)).alias("middle"))
    k = F.coalesce(F.round((F.col(v) - F.col("middle")) / F.nullif("width", F.lit(0.0))), F.lit(0.0))
    return pix.join(about, "img").groupBy("img", (F.col("middle") + k * F.col("width")).alias("centre")).agg(F.count(F.lit(1)).alias("n"))


def percentile_range(pix: DataFrame, v: str = "v", share: float = 0.1, bins: int = 101) -> DataFrame:
    """(img, lo, hi): the values with ``share`` of the pixels below and above, moved apart about their mean by 1 / (1 - 2 share).

    They are read off the bins of ``centred_histogram``, linearly inside a bin (of several bins with the same count, the first); a constant image gets 0.5 on each side.
    """
    about = pix.groupBy("img").agg(((F.max(v) - F.min(v)) / bins).cast("double").alias("width"), F.avg(v).alias("middle"), F.count(v).alias("total"))
    k = F.coalesce(F.round((F.col(v) - F.col("middle")) / F.nullif("width", F.lit(0.0))), F.lit(0.0))
    counts = pix.where(F.col(v).isNotNull()).join(about, "img").groupBy("img", "width", "middle", "total", k.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("upto", F.sum("n").over(W.partitionBy("img").orderBy("k")))
    want = lambda q: F.col("total") * q
    holds = lambda q: (F.col("upto") - F.col("n") < want(q)) & (F.col("upto") >= want(q))
    inside = lambda q: F.col("middle") + F.col("width") * (F.col("k") - 0.5 + (want(q) - F.col("upto") + F.col("n")) / F.col("n"))
    ends = counts.groupBy("img").agg(*[F.max(F.when(holds(q), inside(q))).alias(x) for x, q in (("p", share), ("q", 1 - share))])
    mid, half = (F.col("p") + F.col("q")) / 2, (F.col("q") - F.col("p")) / 2 / (1 - 2 * share)
    half = F.when(2 * half > 2.220446049250313e-16, half).otherwise(0.5)
    return ends.select("img", (mid - half).alias("lo"), (mid + half).alias("hi"))


def entropy(pix: DataFrame, v: str = "v", bins: float = 256) -> DataFrame:
    """(img, entropy): bits of the histogram between least and largest value."""
    n = F.col("n").cast("double")
    return centred_histogram(pix, v, bins).groupBy("img").agg((F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias("entropy"))


def difference_stats(pix: DataFrame, one: str, other: str) -> DataFrame:
    """Range, mean and deviation of one - other, and the signal-to-noise ratio in dB: variance of ``one`` over that of the difference; infinite without a difference."""
    d = F.col(one) - F.col(other)
    out = pix.groupBy("img").agg(F.min(d).alias("lo"), F.max(d).alias("hi"), F.avg(d).alias("mean"), F.coalesce(F.var_samp(d), F.lit(0.0)).alias("var"), F.coalesce(F.var_samp(one), F.lit(0.0)).alias("signal"))
    tiny = F.col("var") < 2.2250738585072014e-308
    snr = F.when(tiny, F.lit(float("inf"))).when(F.col("signal") > 0, 10 * F.log10(F.col("signal") / F.when(~tiny, F.col("var")))).otherwise(F.lit(float("-inf")))
    return out.select("img", "lo", "hi", "mean", F.sqrt("var").alias("sd"), snr.alias("snr"))


def median(pix: DataFrame, v: str = "v") -> DataFrame:
    return pix.groupBy("img").agg(F.median(v).alias("median"))
