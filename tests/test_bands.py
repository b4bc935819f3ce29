"""Pyramids as relations against plain loops, and their way back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfuse.operators import bands
from lumenfuse.operators.convolve import high_from_low
from lumenfuse.operators.filter_banks import BANKS, SP1, named


def image(shape, seed=1):
    return np.random.default_rng(seed).integers(0, 256, shape).astype(float)


def rows_of(spark, *images):
    data = [(i, *x.shape, x.ravel().tolist()) for i, x in enumerate(images)]
    return bands.from_images(spark.createDataFrame(data, "img long, h int, w int, a array<double>"), "a")


def matrices(rows):
    """(img, level, band) to a matrix."""
    out = {}
    for r in rows.collect():
        out.setdefault((r["img"], r["level"], r["band"]), {})[r["r"], r["c"]] = r["a"]
    made = {}
    for k, cells in out.items():
        m = np.full((max(r for r, _ in cells) + 1, max(c for _, c in cells) + 1), np.nan)
        for (r, c), v in cells.items():
            m[r, c] = v
        assert not np.isnan(m).any()
        made[k] = m
    return made


MODE = {"reflect1": "reflect", "reflect2": "symmetric", "circular": "wrap", "repeat": "edge", "zero": "constant"}


def correlate(x, kernel, edges="reflect1", step=(1, 1), start=(0, 0), turned=False):
    k = np.asarray(kernel, float)
    k = k[::-1, ::-1] if turned else k
    before = [(n - 1) // 2 if turned and n % 2 == 0 else n // 2 for n in k.shape] if not turned else [n - 1 - (n - 1) // 2 for n in k.shape]
    y = np.pad(x, [(b, n - 1 - b) for b, n in zip(before, k.shape)], mode=MODE[edges])
    out = np.zeros(x.shape)
    for i in range(k.shape[0]):
        for j in range(k.shape[1]):
            out += k[i, j] * y[i : i + x.shape[0], j : j + x.shape[1]]
    return out[start[0] :: step[0], start[1] :: step[1]]


def expand(x, kernel, shape, edges="reflect1", start=(0, 0), step=2):
    y = np.zeros(shape)
    y[start[0] :: step, start[1] :: step] = x
    return correlate(y, kernel, edges, turned=True)


def close(a, b):
    assert a.shape == b.shape and np.abs(a - b).max() < 1e-9


@pytest.mark.parametrize("edges, shape", [("reflect1", (9, 14)), ("reflect2", (5, 1)), ("circular", (8, 16)), ("repeat", (9, 14)), ("zero", (5, 1))])
def test_laplacian_bands_equal_loops_and_fold_back(spark, edges, shape):
    x, taps, height = image(shape), named("binom5"), 2
    lows = [x]
    for _ in range(height):
        lows.append(correlate(correlate(lows[-1], [[t] for t in taps], edges)[::2], [taps], edges)[:, ::2])
    want = [a - expand(b, np.outer(taps, taps), a.shape, edges) for a, b in zip(lows, lows[1:])] + [lows[-1]]
    pyr = bands.laplacian_pyramid(rows_of(spark, x), height, edges=edges).cache()
    got = matrices(pyr)
    assert len(got) == height + 1
    for k, m in enumerate(want):
        close(got[0, k, 0], m)
    close(matrices(bands.laplacian_image(pyr, height, edges=edges))[0, 0, 0], x)
    left = matrices(bands.laplacian_image(pyr, height, edges=edges, levels={1, 2}))[0, 0, 0]
    close(left, x - want[0])
    gauss = matrices(bands.gaussian_pyramid(rows_of(spark, x), height, edges=edges))
    for k, m in enumerate(lows):
        close(gauss[0, k, 0], m)
    pyr.unpersist()


def test_a_band_is_replaced(spark):
    x, y = image((12, 10), 2), image((12, 10), 3)
    pyr = bands.laplacian_pyramid(rows_of(spark, x, y), 2)
    mine = pyr.where("level = 1")
    twice = bands.set_band(pyr, 1, 0, mine.select("img", "r", "c", (2 * F.col("a")).alias("a")))
    got, was = matrices(bands.laplacian_image(twice, 2)), matrices(pyr)
    for i, z in enumerate((x, y)):
        close(got[i, 0, 0], z + expand(was[i, 1, 0], np.outer(bands.BINOMIAL5, bands.BINOMIAL5), z.shape))
    with pytest.raises(Exception, match="does not fit"):
        bands.set_band(pyr, 1, 0, mine.select("img", (F.col("r") + 50).alias("r"), "c", "a")).count()
    gone = bands.set_band(pyr, 0, 0, pyr.where("level = 0 and img = 1").select("img", "r", "c", "a"))
    assert gone.where("level = 0").select("img").distinct().count() == 1


@pytest.mark.parametrize("name, edges, most", [("qmf9", "reflect1", 0.01), ("qmf13", "reflect1", 0.01), ("haar", "circular", 1e-9), ("daub3", "circular", 1e-9), ("qmf8", "circular", 0.02)])
def test_qmf_bands_equal_loops_and_fold_back(spark, name, edges, most):
    x, taps, height = image((16, 24)), named(name), 2
    high, start = high_from_low(taps), 1 if len(taps) % 2 == 0 else 0
    down = lambda z, t, first, axis: correlate(z, [[v] for v in t] if axis == 0 else [t], edges)[first::2] if axis == 0 else correlate(z, [t], edges)[:, first::2]
    pyr = bands.qmf_pyramid(rows_of(spark, x), height, taps, edges).cache()
    got, low = matrices(pyr), x
    for level in range(1, height + 1):
        lo, hi = down(low, taps, start, 0), down(low, high, 1, 0)
        for band, (z, t, first) in enumerate(((lo, taps, start), (hi, taps, start), (lo, high, 1), (hi, high, 1))):
            if band or level == height:
                close(got[0, level, band], down(z, t, first, 1))
        low = down(lo, taps, start, 1)
    assert len(got) == 3 * height + 1
    back = matrices(bands.qmf_image(pyr, height, taps, edges))[0, 0, 0]
    # what the bank leaves out by itself: its two responses do not quite add up to 1 at every frequency
    short = np.abs(sum(np.abs(np.fft.fft(t, 4096)) ** 2 for t in (taps, high)) / 2 - 1).max()
    assert np.linalg.norm(back - x) <= ((1 + short) ** (2 * height) - 1) * np.linalg.norm(x) + 1e-9 and short < most
    part = [matrices(bands.qmf_image(pyr, height, taps, edges, levels={k}))[0, 0, 0] for k in (1, 2, 3)]
    close(sum(part), back)
    one = [matrices(bands.qmf_image(pyr, height, taps, edges, levels={1}, bands={b}))[0, 0, 0] for b in (1, 2, 3)]
    close(sum(one), part[0])
    pyr.unpersist()


@pytest.mark.parametrize("name", sorted(BANKS))
def test_steerable_bands_equal_loops_and_fold_back(spark, name):
    x, bank, height = image((24, 21)), BANKS[name], 1
    smooth = correlate(x, np.outer(*[named("binom5")] * 2) / 2)
    pyr = bands.steerable_bands(rows_of(spark, smooth), height, bank).cache()
    got = matrices(pyr)
    low = correlate(smooth, bank.low0)
    close(got[0, 0, 1], correlate(smooth, bank.high0))
    for b, kernel in enumerate(bank.bands):
        close(got[0, 1, b + 1], correlate(low, kernel))
    close(got[0, 1, 0], correlate(low, bank.low)[::2, ::2])
    assert len(got) == 2 + len(bank.bands)
    back = matrices(bands.steerable_image(pyr, height, bank))[0, 0, 0]
    assert np.abs(back - smooth)[4:-4, 4:-4].max() < 0.02 * smooth.max()
    parts = sum(matrices(bands.steerable_image(pyr, height, bank, levels={k}))[0, 0, 0] for k in (0, 1, 2))
    close(parts, back)
    pyr.unpersist()


def test_steps_do_not_shuffle_again(spark):
    pyr = bands.laplacian_pyramid(rows_of(spark, image((8, 8))), 2)
    plan = bands.laplacian_image(pyr, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_empty_table_and_height(spark):
    none = rows_of(spark, image((8, 8))).where("false")
    assert bands.qmf_pyramid(none, 1, named("qmf9")).count() == 0
    assert bands.max_height((64, 48), 9) == 3 and bands.max_height((8, 8), 9) == 0 and bands.max_height((1, 40), 5) == 4
    assert named("qmf16")[0] == named("qmf16")[-1] and abs(sum(named("binom5")) - 2**0.5) < 1e-12
    with pytest.raises(ValueError):
        named("qmf7")
    assert len(SP1.bands) == 2 and SP1.low[0][8] == 1.262e-3
