"""Steerable pyramids: reconstruction, steering and the relation of their bands."""

import math

import numpy as np
import pytest

from lumenfuse.operators import steerable

X = np.random.default_rng(3).random((64, 48))


@pytest.mark.parametrize("order", [0, 1, 2, 3, 5])
@pytest.mark.parametrize("shape", [(64, 48), (33, 40), (63, 49), (35, 37), (64, 64)])
def test_the_image_comes_back(order, shape):
    x = np.random.default_rng(3).random(shape)
    parts = steerable.decompose(x, steerable.max_height(shape), order)
    assert np.allclose(steerable.compose(parts, order), x, atol=1e-12)
    # levels add up
    top = steerable.max_height(shape) + 1
    assert np.allclose(steerable.compose(parts, order, levels={0, top}) + steerable.compose(parts, order, levels=set(range(1, top))), steerable.compose(parts, order))


def test_analytic_bands_have_the_plain_ones_as_real_part():
    low = np.fft.ifft2(np.fft.fft2(X) * (np.abs(np.fft.fftfreq(64))[:, None] < 0.4) * (np.abs(np.fft.fftfreq(48)) < 0.4)).real
    for (k, b, v), (_, _, w) in zip(steerable.decompose(low, 2, 3), steerable.decompose(low, 2, 3, analytic=True)):
        assert np.allclose(v, w.real, atol=1e-2 if k else 1e-9), (k, b)


def test_steering_to_a_bands_own_angle_gives_the_band():
    for order in (0, 1, 2, 3, 4):
        for b in range(order + 1):
            assert np.allclose(steerable.steering_weights(order, math.pi * b / (order + 1)), np.eye(order + 1)[b])


def test_steering_equals_an_oriented_filter():
    for angle in (0.3, 1.1):
        w = steerable.steering_weights(3, angle)
        t = np.linspace(-3, 3, 50)
        got = sum(k * steerable._oriented(t, b, 3, False) for b, k in enumerate(w))
        assert np.allclose(got, steerable._oriented(t - angle, 0, 3, False))


def test_rows_of_bands(spark):
    img = spark.createDataFrame([(1, 64, 48, X.ravel().tolist()), (2, 2, 2, [1.0] * 4)], "img long, h int, w int, a array<double>")
    pyr = steerable.steerable_pyramid(img, order=1).cache()
    got = {(r["img"], r["level"], r["band"]): r for r in pyr.collect()}
    assert {k[1:] for k in got if k[0] == 1} == {(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 1), (4, 0)} and {k[1:] for k in got if k[0] == 2} == {(0, 0), (1, 0)}
    assert got[1, 4, 0]["h"] == 8 and got[1, 1, 0]["imag"] is None
    turned = {(r["img"], r["level"]): r["px"] for r in steerable.steer(pyr, 0.7, 1).collect()}
    w = steerable.steering_weights(1, 0.7)
    assert set(turned) == {(1, 1), (1, 2), (1, 3)}
    assert np.allclose(turned[1, 2], w[0] * np.array(got[1, 2, 0]["px"]) + w[1] * np.array(got[1, 2, 1]["px"]))
    assert steerable.steerable_pyramid(img, order=1, analytic=True).where("level = 1 and imag is not null").count() == 2
    with pytest.raises(ValueError):
        steerable.decompose(X, 9)
