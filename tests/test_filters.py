"""Filters, point operations, synthetic images and colours against NumPy."""

import math

import numpy as np
import pytest
import window_scores
from pyspark.sql import functions as F

from lumenfuse.functions import color, synth
from lumenfuse.operators import convolve, points, windowed

RNG = np.random.default_rng(8)
PAD = {"reflect1": {"mode": "reflect"}, "reflect2": {"mode": "symmetric"}, "circular": {"mode": "wrap"}, "repeat": {"mode": "edge"}, "zero": {"mode": "constant"}, "extend": {"mode": "reflect", "reflect_type": "odd"}}


def pixels(spark, x):
    h, w = x.shape
    return spark.createDataFrame([(1, i // w, i % w, float(v)) for i, v in enumerate(x.ravel())], "img long, r int, c int, v double")


def matrix(df, v="v"):
    rows = df.collect()
    out = np.full((max(r["r"] for r in rows) + 1, max(r["c"] for r in rows) + 1), np.nan)
    for r in rows:
        out[r["r"], r["c"]] = r[v]
    return out


def correlated(x, k, edges):
    top, left = k.shape[0] // 2, k.shape[1] // 2
    p = np.pad(x, ((top, k.shape[0] - 1 - top), (left, k.shape[1] - 1 - left)), **PAD[edges])
    return sum(k[i, j] * p[i : i + x.shape[0], j : j + x.shape[1]] for i in range(k.shape[0]) for j in range(k.shape[1]))


@pytest.mark.parametrize("edges", PAD)
def test_correlation_and_convolution(spark, edges):
    x, k = RNG.random((9, 7)), RNG.random((4, 3))
    pix = pixels(spark, x)
    want = correlated(x, k, edges)
    assert np.allclose(matrix(convolve.corr_down(pix, k.tolist(), edges)), want)
    assert np.allclose(matrix(convolve.corr_down(pix, k.tolist(), edges, (2, 3), (1, 0), (8, 7))), want[1:8:2, ::3])
    odd = RNG.random((3, 5))
    assert np.allclose(matrix(convolve.convolve(pix, odd.tolist(), edges)), correlated(x, odd[::-1, ::-1], edges))


def test_nothing_is_computed_over_the_border(spark):
    x, k = RNG.random((6, 6)), RNG.random((3, 3))
    want = np.zeros((6, 6))
    want[1:-1, 1:-1] = correlated(x, k, "zero")[1:-1, 1:-1]
    assert np.allclose(matrix(convolve.corr_down(pixels(spark, x), k.tolist(), "dont-compute")), want)
    with pytest.raises(ValueError):
        convolve.corr_down(pixels(spark, x), k.tolist(), "none")


def test_blurs(spark):
    x = np.full((9, 6), 5.0)
    assert np.allclose(matrix(convolve.blur_down(pixels(spark, x), 2)), np.full((3, 2), 5.0))
    y = RNG.random((9, 6))
    t = np.array(convolve.binomial(5))
    low = correlated(correlated(y, t[:, None], "reflect1"), t[None, :], "reflect1")[::2, ::2]
    assert np.allclose(matrix(convolve.blur_down(pixels(spark, y))), low)
    up = np.zeros((9, 6))
    up[::2, ::2] = low
    assert np.allclose(matrix(convolve.blur(pixels(spark, y), (9, 6))), correlated(correlated(up, t[:, None], "reflect1"), t[None, :], "reflect1"))
    wide = np.zeros((18, 12))
    wide[::2, ::2] = y
    assert np.allclose(matrix(convolve.blur_up(pixels(spark, y))), correlated(correlated(wide, t[:, None], "reflect1"), t[None, :], "reflect1"))


def test_gradient_of_a_ramp(spark):
    g = convolve.gradient(synth.ramp(spark, 12, 12, 0.7, 3.0).withColumn("img", F.lit(1)))
    mid = g.where("r between 3 and 8 and c between 3 and 8").agg(F.avg("dx").alias("dx"), F.avg("dy").alias("dy")).first()
    assert (mid["dx"], mid["dy"]) == (pytest.approx(3 * math.cos(0.7), rel=1e-2), pytest.approx(3 * math.sin(0.7), rel=1e-2))


def test_shift_part_and_product(spark):
    x = RNG.random((4, 5))
    pix = pixels(spark, x)
    assert np.array_equal(matrix(convolve.shift(pix, (4, 5), (1, -2))), np.roll(x, (1, -2), (0, 1)))
    assert np.array_equal(matrix(convolve.part(pix, (1, 2), (2, 3))), x[1:3, 2:5])
    assert convolve.inner_product(pix, "v", "v").first()["inner"] == pytest.approx((x * x).sum())
    assert np.dot(convolve.high_from_low([1, 2, 3, 4]), [1, 2, 3, 4]) == 0


def test_look_up(spark):
    x = np.array([[-10.0, 0.0, 12.5, 25.0, 99.0]])
    table = [0.0, 10.0, 40.0]
    want = np.interp(x, [0, 10, 20], table)
    want[x > 20] = 40 + 3 * (x[x > 20] - 20)
    want[x < 0] = x[x < 0]
    assert np.allclose(matrix(points.point_op(pixels(spark, x), table, 0.0, 10.0)), want)


def test_histogram_matching(spark):
    x = RNG.normal(10, 4, (20, 20))
    counts, centres = [1, 4, 10, 4, 1, 0], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0]
    n = len(counts)
    have, edges = np.histogram(x, n)
    full = np.array(counts) + np.mean(counts) / 1e8
    targets = np.interp(np.concatenate(([0], np.cumsum(have))) / have.sum(), np.concatenate(([0], np.cumsum(full))) / full.sum(), [-0.5, *[c + 0.5 for c in centres]])
    assert np.allclose(matrix(points.match_histogram(pixels(spark, x), counts, centres)), np.interp(x, edges, targets))
    flat = np.full((2, 2), 3.0)
    assert np.array_equal(matrix(points.match_histogram(pixels(spark, flat), counts, centres)), flat)


def test_flat_images(spark):
    flat = pixels(spark, np.full((3, 3), 7.0)).withColumn("w", F.col("v"))
    assert points.entropy(flat).first()["entropy"] == 0
    assert points.difference_stats(flat, "v", "w").first()["snr"] == float("inf")
    assert points.centred_histogram(flat).first()["n"] == 9
    assert points.median(flat).first()["median"] == 7


def test_soft_edges_meet_the_hard_ones(spark):
    hard, soft = matrix(synth.disc(spark, 21, 21, 6.0)), matrix(synth.disc(spark, 21, 21, 6.0, 2.0))
    away = np.abs(np.hypot(*np.meshgrid(np.arange(21) - 10, np.arange(21) - 10)) - 6) > 1.01
    assert np.allclose(hard[away], soft[away]) and 0.05 < soft[~away].mean() < 0.95
    assert set(np.round(np.unique(matrix(synth.square(spark, 8, 40, 20.0, soft=0.01))), 6)) <= {-1.0, 1.0}
    assert synth.triangle(spark, 10).count() == 66


def test_colours_come_back(spark):
    levels = [0, 1, 40, 128, 200, 255]
    d = spark.createDataFrame([(float(r), float(g), float(b)) for r in levels for g in levels for b in levels], "r double, g double, b double")
    lab = color.rgb_to_lab(*map(F.col, "rgb"))
    back = d.select("r", "g", "b", *[x.alias(k) for x, k in zip(color.lab_to_rgb(*lab), ("r2", "g2", "b2"))]).collect()
    assert max(abs(x[k] - x[f"{k}2"]) for x in back for k in "rgb") <= 1
    for r in d.select("r", *[x.alias(k) for x, k in zip(color.hsv8_to_rgb(F.lit(0), F.lit(255), F.col("r")), ("x", "y", "z"))]).collect():
        assert (r["x"], r["y"], r["z"]) == (pytest.approx(r["r"] / 255), 0, 0)
    got = spark.range(1).select(*[x.alias(k) for x, k in zip(color.chroma_colour(F.lit(-100.0), F.lit(0.0)), "xyz")]).first()
    assert (got["x"], got["y"], got["z"]) == (pytest.approx(210 / 255), 0, pytest.approx(210 / 255 * (1 - (1 - 1 / 30)), abs=0.03))
    grey = spark.range(1).select(color.rgb_to_grey(F.lit(10.0), F.lit(20.0), F.lit(30.0)).alias("g"), color.stretched(F.lit(5.0), F.lit(5.0), F.lit(5.0)).alias("s"), *[x.alias(f"f{i}") for i, x in enumerate(color.false_colour(F.lit(128.0), F.lit(128.0)))]).first()
    assert tuple(grey) == (18.0, 0, 128, 128, 128)
    hsv = spark.range(1).select(*[x.alias(k) for x, k in zip(color.hsv_to_rgb(F.lit(0.0), F.lit(1.0), F.lit(1.0)), "xyz")]).first()
    assert tuple(hsv) == (255, 0, 0)


def test_the_two_forms_of_multi_scale_similarity():
    x = np.random.default_rng(1).integers(0, 256, (64, 64)).astype(float)
    assert window_scores.ms_ssim_loose(x, x, x) == pytest.approx(window_scores.ms_ssim(x, x, x), abs=1e-3)
    assert window_scores.ms_ssim_loose(x[:10], x[:10], x[:10]) is None


def test_scores_of_small_images_are_null(spark):
    d = spark.createDataFrame([(1, 8, 8, [1.0] * 64, [2.0] * 64, [3.0] * 64)], "img long, h int, w int, a array<double>, b array<double>, f array<double>")
    r = windowed.score(d, "VIF", "MS_SSIM", "SSIM").first()
    assert r["VIF"] is None and r["MS_SSIM"] == float("-inf") and r["SSIM"] is not None
    with pytest.raises(Exception, match="reshape"):
        windowed.score(d.withColumn("h", F.lit(9)), "SSIM").collect()
