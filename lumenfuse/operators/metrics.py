"""Fusion quality metrics over triplets (img, r, c, a, b, f): sources a and b, fused image f.

Every function returns one row per img.  Aggregates combine map-side; neighbour access is by windows inside an image.
A quotient with a zero denominator is null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def along_row() -> W:
    return W.partitionBy("img", "r").orderBy("c")


def along_column() -> W:
    return W.partitionBy("img", "c").orderBy("r")



def per(x: Column, y: Column) -> Column:
    return x / F.nullif(y, F.lit(0.0))


# ------------------------------------------------------------ histograms


def entropies(trip: DataFrame) -> DataFrame:
    """Entropies (bits) of a, b, f and of each pair, from one aggregation of levels and grouping sets over its result."""
    levels = trip.groupBy("img", "a", "b", "f").agg(F.count(F.lit(1)).alias("n"))
    sets = [("a",), ("b",), ("f",), ("a", "f"), ("b", "f"), ("a", "b")]
    code = {s: sum(1 << (2 - i) for i, x in enumerate("abf") if x not in s) for s in sets}
    bins = levels.groupingSets([[F.col("img"), *map(F.col, s)] for s in sets], "img", "a", "b", "f").agg(F.grouping_id().alias("g"), F.sum("n").alias("n"))
    total = lambda s, x: F.sum(F.when(F.col("g") == code[s], x))
    n = F.col("n").cast("double")
    out = [(F.log2(total(s, n)) - total(s, n * F.log2(n)) / total(s, n)).alias("h_" + "".join(s)) for s in sets]
    return bins.groupBy("img").agg(*out)


def information(trip: DataFrame) -> DataFrame:
    """EN of f, MI and NMI of f with both sources."""
    e = entropies(trip)
    fa, fb = F.expr("h_f + h_a - h_af"), F.expr("h_f + h_b - h_bf")
    return e.select("img", F.col("h_f").alias("EN"), (fa + fb).alias("MI"), (2 * (per(fa, F.expr("h_f + h_a")) + per(fb, F.expr("h_f + h_b")))).alias("NMI"))


def cross_entropy(trip: DataFrame) -> DataFrame:
    """OCE: mean of KL(a|f) and KL(b|f) over the bins that both have."""
    long = trip.select("img", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).alias("v")) for k in "abf"])).alias("x"))
    bins = long.groupBy("img", "x.v").agg(*[F.count(F.when(F.col("x.k") == k, 1)).cast("double").alias(k) for k in "abf"])
    n = F.sum("f")
    kl = lambda x: F.coalesce(F.sum(F.when((F.col(x) > 0) & (F.col("f") > 0), F.col(x) * F.log2(F.col(x) / F.nullif(F.col("f"), F.lit(0.0))))), F.lit(0.0))
    return bins.groupBy("img").agg(((kl("a") + kl("b")) / n / 2).alias("OCE"))


def tsallis(trip: DataFrame, q: float = 0.43137, as_is: bool = True) -> DataFrame:
    """QTE.  ``as_is`` keeps two oddities of common practice: exchanged marginals, and I_AB added in the denominator."""
    hist = lambda x: trip.groupBy("img", F.col(x).alias("v")).agg(F.count(F.lit(1)).alias(f"m{x}"))
    size = trip.groupBy("img").agg(F.count(F.lit(1)).cast("double").alias("size"))
    marg = {x: hist(x) for x in "abf"}
    total, sign = None, 1 if as_is else -1
    for x, y in ("af", "bf", "ab"):
        joint = trip.groupBy("img", F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("n"))
        first, second = (y, x) if as_is else (x, y)  # whose histogram is read at level x, and at level y
        m1 = marg[first].select("img", F.col("v").alias("x"), F.col(f"m{first}").alias("m1"))
        m2 = marg[second].select("img", F.col("v").alias("y"), F.col(f"m{second}").alias("m2"))
        cells = joint.join(m1, ["img", "x"]).join(m2, ["img", "y"]).join(size, "img")
        term = F.pow(F.col("n") / F.col("size"), F.lit(q)) / F.pow(F.col("m1") * F.col("m2") / F.col("size") / F.col("size"), F.lit(q - 1))
        i = size.select("img").join(cells.groupBy("img").agg(F.sum(term).alias("s")), "img", "left").select("img", ((1 - F.coalesce("s", F.lit(0.0))) / (1 - q)).alias(f"i_{x}{y}"))
        total = i if total is None else total.join(i, "img")
    for x in "ab":
        h = marg[x].join(size, "img").groupBy("img").agg(((1 - F.sum(F.pow(F.col(f"m{x}") / F.col("size"), F.lit(q)))) / (1 - q)).alias(f"h_{x}"))
        total = total.join(h, "img")
    denom = F.col("h_a") + F.col("h_b") + sign * F.col("i_ab")
    return total.select("img", F.coalesce(per(F.col("i_af") + F.col("i_bf"), denom), F.lit(0.0)).alias("QTE"))


def ncie(trip: DataFrame) -> DataFrame:
    """Nonlinear correlation information entropy: 3 x 3 matrix of nonlinear correlations, eigenvalues in closed form."""
    lo_hi = trip.groupBy("img").agg(*[g(x).alias(f"{n}_{x}") for x in "abf" for n, g in (("lo", F.min), ("hi", F.max))])
    scaled = lambda x: F.when((F.col(f"hi_{x}") == 0) & (F.col(f"lo_{x}") == 0), F.col(x)).otherwise(F.round(per(F.col(x) - F.col(f"lo_{x}"), F.col(f"hi_{x}") - F.col(f"lo_{x}")) * 255)).alias(x)
    flat = lambda x: (F.col(f"hi_{x}") == F.col(f"lo_{x}")) & (F.col(f"hi_{x}") != 0)
    e = entropies(trip.join(lo_hi, "img").where(~(flat("a") | flat("b") | flat("f"))).select("img", *[scaled(x) for x in "abf"]))
    c = {p: F.expr(f"(h_{p[0]} + h_{p[1]} - h_{p}) / 8") for p in ("ab", "af", "bf")}
    q = e.select("img", *[v.alias(k) for k, v in c.items()]).withColumn("p", F.sqrt(F.expr("(ab * ab + af * af + bf * bf) / 3")))
    q = q.withColumn("t", F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce(per(F.expr("ab * af * bf"), F.expr("p * p * p")), F.lit(0.0))))) / 3)
    lam = [1 + 2 * F.col("p") * F.cos(F.col("t") + k * 2 * math.pi / 3) for k in range(3)]
    part = lambda x: F.when(x > 1e-15, x / 3 * F.log2(F.greatest(x, F.lit(1e-300)) / 3)).otherwise(0.0)
    found = q.select("img", (1 + sum((part(x) for x in lam), F.lit(0.0)) / 8).alias("NCIE"))
    return lo_hi.select("img").join(found, "img", "left")


# ------------------------------------------------------------ moments and correlation


def _moment_columns() -> list[Column]:
    half = (F.avg("a") + F.avg("b")) / 2
    mse = (F.avg(F.expr("(f - a) * (f - a)")) + F.avg(F.expr("(f - b) * (f - b)"))) / 2 / 65025
    psnr = 20 * F.log10(255 / F.nullif(F.sqrt(mse), F.lit(0.0)))
    return [F.stddev_pop("f").alias("SD"), per(F.abs(F.avg("f") - half), half).alias("MLI"), mse.alias("MSE"), psnr.alias("PSNR")]


def moments(trip: DataFrame) -> DataFrame:
    """SD, MLI, MSE (on 0..1) and PSNR (peak 255 over that MSE)."""
    return trip.groupBy("img").agg(*_moment_columns())


def pearson(x: Column, y: Column) -> Column:
    return per(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _correlation_columns() -> list[Column]:
    a, b, f = (F.col(x) for x in "abf")
    return [((pearson(a, f) + pearson(b, f)) / 2).alias("CC"), (pearson(f - b, a) + pearson(f - a, b)).alias("SCD")]


def correlations(trip: DataFrame) -> DataFrame:
    """CC: mean correlation of f with the sources; SCD: sum of correlations of differences."""
    return trip.groupBy("img").agg(*_correlation_columns())


# ------------------------------------------------------------ neighbours


def _steps(trip: DataFrame) -> DataFrame:
    """dr, dc: first differences of f."""
    return trip.withColumns({"dr": F.col("f") - F.lag("f").over(along_column()), "dc": F.col("f") - F.lag("f").over(along_row())})


def _frequency_column() -> Column:
    return F.sqrt(F.coalesce(F.avg(F.expr("dr * dr")), F.lit(0.0)) + F.coalesce(F.avg(F.expr("dc * dc")), F.lit(0.0))).alias("SF")


def spatial_frequency(trip: DataFrame) -> DataFrame:
    return _steps(trip).groupBy("img").agg(_frequency_column())


def central(w: W, x: str = "f") -> Column:
    """Central difference, one-sided at the borders."""
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    return F.coalesce((after - before) / 2, after - F.col(x), F.col(x) - before, F.lit(0.0))


def _gradients(trip: DataFrame) -> DataFrame:
    return trip.withColumns({"gx": central(along_row()), "gy": central(along_column())})


def _gradient_column() -> Column:
    return per(F.sum(F.sqrt(F.expr("(gx * gx + gy * gy) / 2"))), F.max("r").cast("double") * F.max("c")).alias("AG")


def average_gradient(trip: DataFrame) -> DataFrame:
    return _gradients(trip).groupBy("img").agg(_gradient_column())


def sobel(trip: DataFrame, channels: str, border: str) -> DataFrame:
    """x_<ch>, y_<ch>: horizontal and vertical Sobel sums of each channel, separable, in two window passes.

    border: 'replicate', 'mirror' (without repeating the edge) or 'zero'.
    """

    def sides(x: str, w: W) -> tuple[Column, Column]:
        before, after = F.lag(x).over(w), F.lead(x).over(w)
        if border == "mirror":
            return F.coalesce(before, after, F.col(x)), F.coalesce(after, before, F.col(x))
        edge = F.col(x) if border == "replicate" else F.lit(0.0)
        return F.coalesce(before, edge), F.coalesce(after, edge)

    one = trip
    for x in channels:
        lo, hi = sides(x, along_row())
        one = one.withColumns({f"d_{x}": hi - lo, f"s_{x}": lo + 2 * F.col(x) + hi})
    for x in channels:
        lo_d, hi_d = sides(f"d_{x}", along_column())
        lo_s, hi_s = sides(f"s_{x}", along_column())
        one = one.withColumns({f"x_{x}": lo_d + 2 * F.col(f"d_{x}") + hi_d, f"y_{x}": hi_s - lo_s})
    return one.drop(*[f"{k}_{x}" for x in channels for k in "ds"])


def edge_intensity(trip: DataFrame) -> DataFrame:
    return sobel(trip, "f", "replicate").groupBy("img").agg(F.avg(F.sqrt(F.expr("x_f * x_f + y_f * y_f"))).alias("EI"))


def ratio_spatial_frequency(trip: DataFrame) -> DataFrame:
    """rSFe: relative error of the four-direction spatial frequency; diagonals weigh sqrt(2) / 2."""
    ways = {"h": along_row(), "v": along_column(), "m": W.partitionBy("img", F.expr("c - r")).orderBy("r"), "s": W.partitionBy("img", F.expr("c + r")).orderBy("r")}
    d = trip.select("img", *[(F.col(x) - F.lag(x).over(w)).alias(f"{x}{k}") for k, w in ways.items() for x in "abf"])
    weight = {"h": 1.0, "v": 1.0, "m": math.sqrt(2) / 2, "s": math.sqrt(2) / 2}
    fused = sum((F.coalesce(F.sum(F.col(f"f{k}") * F.col(f"f{k}")), F.lit(0.0)) * v for k, v in weight.items()), F.lit(0.0))
    source = sum((F.coalesce(F.sum(F.pow(F.greatest(F.abs(F.col(f"a{k}")), F.abs(F.col(f"b{k}"))), F.lit(2.0))), F.lit(0.0)) * v for k, v in weight.items()), F.lit(0.0))
    n = F.count(F.lit(1))
    return d.groupBy("img").agg(F.sqrt(fused / n).alias("x"), F.sqrt(source / n).alias("y")).select("img", per(F.col("x") - F.col("y"), F.col("y")).alias("rSFe"))


# Fixed values of the edge-transfer metric: gain, slope and centre of both sigmoids, weight exponent, threshold, smallest weight.
NRG, KG, SG, NRA, KA, SA, LG, TD, WT_MIN = 0.9999, 19, 0.5, 0.9995, 22, 0.5, 1.5, 2, 0.001


def _edges(trip: DataFrame) -> DataFrame:
    """q_a, q_b: edge information of each source that f keeps at a pixel; w_a, w_b: their weights; g_*: edge strengths."""
    s = sobel(trip, "abf", "mirror")
    s = s.withColumns({k: v for x in "abf" for k, v in {f"g_{x}": F.sqrt(F.expr(f"x_{x} * x_{x} + y_{x} * y_{x}")) / 8, f"o_{x}": F.when(F.col(f"y_{x}") == 0, F.when(F.col(f"x_{x}") == 0, 0.0).otherwise(F.signum(F.col(f"x_{x}")) * math.pi / 2)).otherwise(F.atan(F.col(f"x_{x}") / F.nullif(F.col(f"y_{x}"), F.lit(0.0))))}.items()})
    for x in "ab":
        strength = F.when((F.col(f"g_{x}") == 0) | (F.col("g_f") == 0), 0.0).otherwise(F.least(f"g_{x}", "g_f") / F.nullif(F.greatest(f"g_{x}", "g_f"), F.lit(0.0)))
        angle = F.abs(F.abs(F.col(f"o_{x}") - F.col("o_f")) - math.pi / 2) * 2 / math.pi
        kept = F.sqrt(NRG / (1 + F.exp(-KG * (strength - SG))) * (NRA / (1 + F.exp(-KA * (angle - SA)))))
        s = s.withColumns({f"q_{x}": kept, f"w_{x}": F.when(F.col(f"g_{x}") >= TD, F.pow(F.col(f"g_{x}"), F.lit(LG))).otherwise(WT_MIN)})
    return s


def _edge_columns() -> list[Column]:
    total, lost = F.sum(F.expr("w_a + w_b")), F.expr("(1 - q_a) * w_a + (1 - q_b) * w_b")
    new = (F.col("g_f") > F.col("g_a")) & (F.col("g_f") > F.col("g_b"))
    both = F.expr("(2 - q_a - q_b) * (w_a + w_b)")
    some = lambda cond, x: F.coalesce(F.sum(F.when(cond, x)), F.lit(0.0)) / total
    return [(F.sum(F.expr("q_a * w_a + q_b * w_b")) / total).alias("QABF"), some(~new, lost).alias("LABF"), some(new, lost).alias("NABF"), some(new, both).alias("NABF1")]


def edge_transfer(trip: DataFrame) -> DataFrame:
    """QABF (edge information kept), LABF (lost), NABF and NABF1 (artefacts, two definitions)."""
    return _edges(trip).groupBy("img").agg(*_edge_columns())


def fusion_gain(trip: DataFrame) -> DataFrame:
    """QDELTA: what f keeps of one source only; QCOMMON: what it keeps of both.  They add up to QABF."""
    s = _edges(trip).withColumn("both", F.least("q_a", "q_b"))
    total = F.sum(F.expr("w_a + w_b"))
    return s.groupBy("img").agg((F.sum(F.expr("(q_a - both) * w_a + (q_b - both) * w_b")) / total).alias("QDELTA"), (F.sum(F.expr("both * (w_a + w_b)")) / total).alias("QCOMMON"))


# Fixed values of the first form of the edge-transfer metric: gain, slope and centre of both sigmoids.
TG, KG1, DG, TA, KA1, DA = 0.9994, -15, 0.5, 0.9879, -22, 0.8


def edge_transfer_first(trip: DataFrame) -> DataFrame:
    """QABF in its first form: zero border, plain weights, product of both sigmoids; equal strengths enter as they are."""
    s = sobel(trip, "abf", "zero")
    s = s.withColumns({k: v for x in "abf" for k, v in {f"g_{x}": F.sqrt(F.expr(f"x_{x} * x_{x} + y_{x} * y_{x}")), f"o_{x}": F.when(F.col(f"x_{x}") == 0, math.pi / 2).otherwise(F.atan(-F.col(f"y_{x}") / F.nullif(F.col(f"x_{x}"), F.lit(0.0))))}.items()})
    for x in "ab":
        g, f = F.col(f"g_{x}"), F.col("g_f")
        strength = F.when(g > f, f / F.nullif(g, F.lit(0.0))).when(g == f, f).otherwise(g / F.nullif(f, F.lit(0.0)))
        angle = 1 - F.abs(F.col(f"o_{x}") - F.col("o_f")) / (math.pi / 2)
        s = s.withColumn(f"q_{x}", TG / (1 + F.exp(KG1 * (strength - DG))) * (TA / (1 + F.exp(KA1 * (angle - DA)))))
    return s.groupBy("img").agg(per(F.sum(F.expr("q_a * g_a + q_b * g_b")), F.sum(F.expr("g_a + g_b"))).alias("QABF_first"))


def native_scores(trip: DataFrame) -> DataFrame:
    """All scores of a batch evaluation that aggregates and windows can express: one pass over windows, one over histograms."""
    wide = _edges(_gradients(_steps(trip)))
    scores = wide.groupBy("img").agg(*_moment_columns(), *_correlation_columns(), _frequency_column(), _gradient_column(), *_edge_columns())
    return information(trip).join(scores, "img")
