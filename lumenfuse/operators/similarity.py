"""Structure and information metrics in sliding windows, on pixel relations: (img, level, h, w, r, c, a, b, f), built-in expressions only.

A separable filter is two passes; in each, every pixel joins a constant list of taps and an aggregation adds up what arrives at the same place.
Images are hash-partitioned once, as rows, so the passes shuffle nothing.  Scales are levels of one relation: a step
hands on the levels it does not touch, so no scale is computed twice, and windows of different size run in one pass.

Each function returns (img, scores...) and leaves out images that have no window.  ``img`` names an image and is not repeated.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfuse.operators import bands

KEYS = ("img", "level", "h", "w", "r", "c")
EPS, ROUNDING = 2.0**-52, 1e-13
NAN = "double('NaN')"
#: Products whose window sums give variances and covariances.
SOURCES_TO_FUSED = ("aa", "bb", "ff", "af", "bf")
ALL_PRODUCTS = (*SOURCES_TO_FUSED, "ab")


def gaussian_taps(n: int, sigma: float) -> list[float]:
    g = [math.exp(-((i - (n - 1) / 2) ** 2) / (2 * sigma * sigma)) for i in range(n)]
    return [x / sum(g) for x in g]


def from_images(images: DataFrame) -> DataFrame:
    """Pixels at level 0 of image rows (img, h, w, a, b, f)."""
    return bands.from_images(images, "a", "b", "f").drop("band")


# ---------------------------------------------------------------- windows


def _along(rows: DataFrame, axis: str, windows: Mapping[int, Sequence[float]], weighted: Sequence[str], plain: Sequence[str] = (), step: int = 1) -> DataFrame:
    """Correlation along one axis where the window fits, at the levels of ``windows``; other levels are handed on.

    Sums of the columns ``weighted`` use the taps, those of ``plain`` do not.
    """
    side = {"r": "h", "c": "w"}[axis]
    by_level = lambda value, other: "case level " + " ".join(f"when {k} then {value(v)}" for k, v in windows.items()) + f" else {other} end"
    taps = by_level(lambda v: "array(" + ", ".join(f"{t!r}D" for t in v) + ")", "array(1.0D)")
    n, stride = by_level(len, 1), by_level(lambda v: step, 1)
    x = rows.select(*KEYS, *weighted, *plain, F.expr(f"posexplode({taps})").alias("i", "tap")).withColumns({"n": F.expr(n), "step": F.expr(stride)})
    x = x.where(f"{axis} >= i and {axis} - i <= {side} - n and ({axis} - i) % step = 0")
    x = x.withColumns({axis: F.expr(f"cast(({axis} - i) div step as int)"), side: F.expr(f"cast(({side} - n) div step as int) + 1")})
    return x.groupBy(*KEYS).agg(*[F.sum(F.col(v) * F.col("tap")).alias(v) for v in weighted], *[F.sum(v).alias(v) for v in plain])


def _filtered(rows: DataFrame, windows: Mapping[int, Sequence[float]], weighted: Sequence[str], plain: Sequence[str] = (), step: int = 1) -> DataFrame:
    for axis in ("c", "r"):
        rows = _along(rows, axis, windows, weighted, plain, step)
    return rows


def _local(rows: DataFrame, windows: Mapping[int, Sequence[float]], products: Sequence[str], plain: Sequence[str] = ()) -> DataFrame:
    """Weighted means of the channels and of ``products`` in each window; ``plain`` ones also as unweighted sums, with the prefix ``sum_``."""
    rows = rows.withColumns({p: F.col(p[0]) * F.col(p[1]) for p in products})
    rows = rows.withColumns({f"sum_{p}": F.col(p) for p in plain})
    return _filtered(rows, windows, [*"abf", *products], [f"sum_{p}" for p in plain])


def _cov(x: str, y: str) -> Column:
    """Covariance of a window; what is below the rounding of the two parts counts as 0, so a flat window is flat."""
    x, y = sorted((x, y))
    d = F.col(x + y) - F.col(x) * F.col(y)
    return F.when(F.abs(d) <= ROUNDING * F.abs(x + y), 0.0).otherwise(d)


def _ssim(x: str, y: str, c1: float, c2: float) -> Column:
    mean, spread = F.col(x) * F.col(x) + F.col(y) * F.col(y) + c1, _cov(x, x) + _cov(y, y) + c2
    return (2 * F.col(x) * F.col(y) + c1) * (2 * _cov(x, y) + c2) / F.nullif(mean * spread, F.lit(0.0))


def _replicated(rows: DataFrame, n: int) -> DataFrame:
    """Images with their edge pixels repeated n times outwards."""
    for axis, side in (("r", "h"), ("c", "w")):
        i, last = F.col(axis), F.col(side) - 1
        rows = rows.withColumn(axis, F.explode(F.sequence(F.when(i == 0, 0).otherwise(i + n), F.when(i == last, i + 2 * n).otherwise(i + n))))
        rows = rows.withColumn(side, F.col(side) + 2 * n)
    return rows


def _again(rows: DataFrame, level: int) -> DataFrame:
    """The rows, and those of the level before once more as ``level``."""
    return rows.withColumn("level", F.explode(F.when(F.col("level") == level - 1, F.array(F.lit(level - 1), F.lit(level))).otherwise(F.array("level"))))


# ---------------------------------------------------------------- metrics


def ssim(rows: DataFrame) -> DataFrame:
    """SSIM: mean of both sources' structural similarity to the fused image; replicated border, dynamic range 1."""
    m = _local(_replicated(rows, 5), {0: gaussian_taps(11, 1.5)}, SOURCES_TO_FUSED)
    return m.groupBy("img").agg(((F.avg(_ssim("f", "a", 1e-4, 9e-4)) + F.avg(_ssim("f", "b", 1e-4, 9e-4))) / 2).alias("SSIM"))


# fixed values of the information metrics: noise variance of VIF; noise variance, guard and scale weights of VIFF
VIF_NOISE = 2.0
VIFF_NOISE, VIFF_GUARD, VIFF_WEIGHTS = 0.005 * 255 * 255, 1e-7, (1, 0, 0.15, 1)
FLAT = 1e-10


def information_fidelity(rows: DataFrame) -> DataFrame:
    """VIF (sum over both sources) and VIFF (per pixel the source of smaller gain), four scales.

    The fused image is a source's times a local gain, plus a remainder; where either is flat, or the gain would be negative, there is none.
    """
    taps = {k: gaussian_taps(n, n / 5) for k, n in enumerate((17, 9, 5, 3))}
    for k in (1, 2, 3):
        rows = _filtered(_again(rows, k), {k: taps[k]}, "abf", step=2)
    m = _local(rows, taps, SOURCES_TO_FUSED)
    m = m.select("img", "level", *[F.greatest(_cov(x, x), F.lit(0.0)).alias(f"v_{x}") for x in "abf"], *[_cov(x, "f").alias(f"k_{x}") for x in "ab"])
    raw = {f"g_{x}": F.when((F.col(f"v_{x}") < FLAT) | (F.col("v_f") < FLAT), 0.0).otherwise(F.col(f"k_{x}") / (F.col(f"v_{x}") + FLAT)) for x in "ab"}
    m = m.withColumns(raw)
    rest = {x: F.when(F.col("v_f") < FLAT, 0.0).when((F.col(f"v_{x}") < FLAT) | (F.col(f"g_{x}") < 0), F.col("v_f")).otherwise(F.col("v_f") - F.col(f"g_{x}") * F.col(f"k_{x}")) for x in "ab"}
    m = m.select("img", "level", *[F.greatest(rest[x], F.lit(FLAT)).alias(f"rest_{x}") for x in "ab"], *[F.greatest(f"g_{x}", F.lit(0.0)).alias(f"g_{x}") for x in "ab"], *[F.when(F.col(f"v_{x}") < FLAT, 0.0).otherwise(F.col(f"v_{x}")).alias(f"v_{x}") for x in "ab"])
    top = lambda x, noise: F.log10(1 + F.col(f"g_{x}") * F.col(f"g_{x}") * F.col(f"v_{x}") / (F.col(f"rest_{x}") + noise))
    low = lambda x, noise: F.log10(1 + F.col(f"v_{x}") / noise)
    either = lambda part: F.when(F.col("g_a") < F.col("g_b"), part("a", VIFF_NOISE)).otherwise(part("b", VIFF_NOISE)) + VIFF_GUARD
    sums = [F.sum(part(x, VIF_NOISE)).alias(f"{name}_{x}") for x in "ab" for name, part in (("top", top), ("low", low))]
    scales = m.groupBy("img", "level").agg(*sums, (F.sum(either(top)) / F.sum(either(low))).alias("score"))
    one = lambda x: F.sum(f"top_{x}") / F.nullif(F.sum(f"low_{x}"), F.lit(0.0))
    weight = F.array(*[F.lit(w / sum(VIFF_WEIGHTS)) for w in VIFF_WEIGHTS])[F.col("level")]
    return scales.groupBy("img").agg(F.coalesce(one("a") + one("b"), F.expr(NAN)).alias("VIF"), F.sum(weight * F.col("score")).alias("VIFF"))


# fixed values of the multi-scale metric: window, scale weights, stabiliser, largest power
SIZE, MS_WEIGHTS, MS_C, MOST = 11, (0.0448, 0.2856, 0.3001), (0.03 * 255) ** 2, 10.0


def _halved(rows: DataFrame, level: int, before: bool) -> DataFrame:
    """``level`` from the one before: 2 x 2 means with a symmetric border, of each second pixel with the next one, or with the one ``before``."""
    rows = _again(rows, level)
    on = F.col("level") == level
    for axis, side in (("r", "h"), ("c", "w")):
        i, n = F.col(axis), F.col(side)
        half = F.floor((n + 1) / 2).cast("int")
        twice = (i == 0) if before else (i == n - 1) & (n % 2 == 1)
        to = F.floor((i + 1) / 2 if before else i / 2).cast("int")
        weight = F.when(on, F.when(twice, 1.0).otherwise(0.5)).otherwise(1.0)
        rows = rows.where(~on | (to < half)).withColumns({v: F.col(v) * weight for v in "abf"} | {axis: F.when(on, to).otherwise(i), side: F.when(on, half).otherwise(n)})
    return rows.groupBy(*KEYS).agg(*[F.sum(v).alias(v) for v in "abf"])


def _exposure(rows: DataFrame, loose: bool) -> DataFrame:
    """(img, level, score): agreement of the fused image with the patch both sources ask for.

    That patch is a combination of the sources' centred patches, so its variance and covariances follow from theirs: plain sums give its
    contrast, Gaussian means its similarity.  Plain sums of grey levels are exact, so flat windows are flat.
    """
    windows = {k: gaussian_taps(SIZE, 1.5) for k in range(3)}
    m = _local(rows, windows, ALL_PRODUCTS, ("a", "b", "aa", "bb", "ab"))
    n, small = SIZE * SIZE, 1e-10 if loose else EPS
    plain = lambda x, y: (n * F.col(f"sum_{x}{y}") - F.col(f"sum_{x}") * F.col(f"sum_{y}")) / n
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0)))
    m = m.withColumns({"u_aa": plain("a", "a"), "u_bb": plain("b", "b"), "u_ab": plain("a", "b")} | {f"k_{x}{y}": _cov(x, y) for x, y in ALL_PRODUCTS})
    m = m.withColumn("ratio", (root(F.col("u_aa") + 2 * F.col("u_ab") + F.col("u_bb")) + small) / (root(F.col("u_aa")) + root(F.col("u_bb")) + small))
    ratio = F.least(F.greatest("ratio", F.lit(small)), F.lit(1 - small)) if loose else F.when(F.col("ratio") > 1, 1 - EPS).otherwise(F.col("ratio"))
    m = m.withColumns({"power": F.least(F.tan(math.pi / 2 * ratio), F.lit(MOST)), "e_a": root(F.col("u_aa")) + 0.001, "e_b": root(F.col("u_bb")) + 0.001})
    m = m.withColumns({f"w_{x}": F.pow(F.col(f"e_{x}") / SIZE, "power") + (0.0 if loose else EPS) for x in "ab"})
    total, guard = F.col("w_a") + F.col("w_b") + (small if loose else 0.0), small if loose else 0.0
    m = m.withColumns({f"p_{x}": F.col(f"w_{x}") / total / (F.col(f"e_{x}") + guard) for x in "ab"})
    both = lambda k: F.col("p_a") * F.col("p_a") * F.col(f"{k}_aa") + 2 * F.col("p_a") * F.col("p_b") * F.col(f"{k}_ab") + F.col("p_b") * F.col("p_b") * F.col(f"{k}_bb")
    m = m.withColumns({"norm": root(both("u")), "k_ww": both("k"), "k_wf": F.col("p_a") * F.col("k_af") + F.col("p_b") * F.col("k_bf")})
    m = m.withColumn("s", F.when(F.col("norm") > 0, F.greatest("e_a", "e_b") / F.col("norm")).otherwise(1.0))
    score = (2 * F.col("s") * F.col("k_wf") + MS_C) / (F.col("s") * F.col("s") * F.col("k_ww") + F.col("k_ff") + MS_C)
    return m.groupBy("img", "level").agg(F.avg(score).alias("score"))


def multi_scale(rows: DataFrame, loose: bool = False) -> DataFrame:
    """MS_SSIM: exposure-aware structure quality over three scales, weighted powers; ``loose`` is the other common form (halving, guards), MS_SSIM_loose."""
    for k in (1, 2):
        rows = _halved(rows, k, before=loose)
    scales = _exposure(rows, loose)
    score = lambda k: F.max(F.when(F.col("level") == k, F.greatest("score", F.lit(0.0)) if loose else F.col("score")))
    out = F.lit(1.0)
    for k, w in enumerate(MS_WEIGHTS):
        out = out * F.pow(score(k), F.lit(w / sum(MS_WEIGHTS)))
    return scales.groupBy("img").agg(out.alias("MS_SSIM_loose" if loose else "MS_SSIM"))


def _edges(rows: DataFrame) -> DataFrame:
    """Level 1 beside level 0: Prewitt edge strength with zeros around the image."""
    cells = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    entry = lambda i, j: F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(-j)).alias("tx"), F.lit(float(-i)).alias("ty"))
    x = rows.where("level = 0").select(*KEYS, *"abf", F.inline(F.array(*[entry(i, j) for i, j in cells])))
    x = x.withColumns({"r": F.col("r") - F.col("i"), "c": F.col("c") - F.col("j"), "level": F.lit(1)}).where("r >= 0 and c >= 0 and r < h and c < w")
    sums = x.groupBy(*KEYS).agg(*[F.sum(F.col(v) * F.col(t)).alias(f"{t}_{v}") for v in "abf" for t in ("tx", "ty")])
    return rows.unionByName(sums.select(*KEYS, *[F.hypot(f"tx_{v}", f"ty_{v}").alias(v) for v in "abf"]))


def saliency_weighted(rows: DataFrame) -> DataFrame:
    """Q (plain), Qw (windows weighted by their larger variance) and Qe (weighted, on edges, squared)."""
    taps, c1, c2 = gaussian_taps(11, 1.5), (0.01 * 255) ** 2, (0.03 * 255) ** 2
    m = _local(_edges(rows), {0: taps, 1: taps}, SOURCES_TO_FUSED)
    m = m.withColumns({"v_a": _cov("a", "a"), "v_b": _cov("b", "b"), "q_a": _ssim("f", "a", c1, c2), "q_b": _ssim("f", "b", c1, c2)})
    flat = F.when(F.col("v_a") + F.col("v_b") == 0, 0.5).otherwise(0.0)
    m = m.withColumns({"v_a": F.col("v_a") + flat, "v_b": F.col("v_b") + flat})
    share = F.col("v_a") / (F.col("v_a") + F.col("v_b"))
    m = m.select("img", "level", (share * F.col("q_a") + (1 - share) * F.col("q_b")).alias("q"), F.greatest("v_a", "v_b").alias("weight"))
    levels = m.groupBy("img", "level").agg(F.avg("q").alias("q"), (F.sum(F.col("weight") * F.col("q")) / F.sum("weight")).alias("qw"))
    at = lambda k, v: F.max(F.when(F.col("level") == k, F.col(v)))
    return levels.groupBy("img").agg(at(0, "q").alias("Q"), at(0, "qw").alias("Qw"), F.pow(at(1, "qw"), F.lit(2.0)).alias("Qe"))


# fixed values of both: stabiliser, and the agreement from which QY blends
TINY, AGREE = 2e-16, 0.75


def agreement(rows: DataFrame) -> DataFrame:
    """QY (blend by local variance where the sources agree, the better source elsewhere) and QC (weighted by the share of local covariance).

    A window whose shares are undefined (all flat) makes the score NaN.
    """
    m = _local(rows, {0: gaussian_taps(7, 1.5)}, ALL_PRODUCTS)
    ratio = lambda x, y: F.coalesce(x / F.nullif(x + y, F.lit(0.0)), F.expr(NAN))
    m = m.select("img", *[F.coalesce(_ssim(x, y, TINY, TINY), F.expr(NAN)).alias(f"q_{x}{y}") for x, y in ("ab", "af", "bf")], ratio(_cov("a", "a"), _cov("b", "b")).alias("v"), ratio(_cov("a", "f"), _cov("b", "f")).alias("k"))
    blend = lambda k: F.col(k) * F.col("q_af") + (1 - F.col(k)) * F.col("q_bf")
    qy = F.when(F.col("q_ab") >= AGREE, blend("v")).otherwise(F.greatest("q_af", "q_bf"))
    qc = F.when(F.isnan("k"), F.col("k")).when(F.col("k") < 0, 0.0).when(F.col("k") > 1, 1.0).otherwise(blend("k"))
    return m.groupBy("img").agg(F.avg(qy).alias("QY"), F.avg(qc).alias("QC"))


FAMILIES = {
    ("SSIM",): ssim,
    ("MS_SSIM",): multi_scale,
    ("MS_SSIM_loose",): lambda rows: multi_scale(rows, loose=True),
    ("VIF", "VIFF"): information_fidelity,
    ("Q", "Qw", "Qe"): saliency_weighted,
    ("QY", "QC"): agreement,
}
METRICS = tuple(name for names in FAMILIES for name in names)
#: Shortest side of an image that has a score, and what smaller ones get.
LEAST = {"MS_SSIM": (44, float("-inf")), "MS_SSIM_loose": (41, None), "VIF": (41, None), "VIFF": (41, None), "Q": (11, float("-inf")), "Qw": (11, float("-inf")), "Qe": (11, float("-inf")), "QY": (7, None), "QC": (7, None)}


def score(images: DataFrame, *names: str) -> DataFrame:
    """(img, names...) for image rows (img, h, w, a, b, f), one row an image.

    A channel whose length is not h * w is an error; images with a null channel or side have null scores.
    """
    fits = F.lit(True)
    for x in "abf":
        fits = fits & F.coalesce(F.size(x) == F.col("h") * F.col("w"), F.lit(True))
    images = images.select("img", "h", "w", *[F.when(fits, F.col(x)).otherwise(F.raise_error(F.lit("cannot reshape a channel into h x w")).cast("array<double>")).alias(x) for x in "abf"])
    whole = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("f").isNotNull() & F.col("h").isNotNull() & F.col("w").isNotNull()
    rows = from_images(images.where(whole))
    out = images.select("img", "h", "w", whole.alias("whole"))
    for family, run in FAMILIES.items():
        if wanted := set(family) & set(names):
            out = out.join(run(rows).select("img", *wanted), "img", "left")
    side = F.least("h", "w")
    limited = lambda n: F.when(~F.col("whole"), None).when(side < LEAST[n][0], LEAST[n][1]).otherwise(F.col(n)) if n in LEAST else F.col(n)
    return out.select("img", *[limited(n).cast("double").alias(n) for n in names])
