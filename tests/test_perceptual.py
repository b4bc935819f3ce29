"""Feature, contrast and order metrics, wavelets and image files against plain versions."""

import math

import numpy as np
import pytest

from lumenfuse.operators import fusion, perceptual, wavelet, windowed
from lumenfuse.sources import files, raster

RNG = np.random.default_rng(7)
A, B, G = (RNG.integers(0, 256, (12, 14)).astype(float) for _ in range(3))


def plain_share(s, f):
    """One window by nested loops."""
    p, q = s / s.sum(), f / f.sum()
    n = len(p)
    dp, dq = p - p.mean(), q - q.mean()
    dot = (dp * dq).sum()
    c = 0 if abs(dot) < 1e-14 else dot / math.sqrt((dp @ dp) * (dq @ dq))
    sd = [math.sqrt(max(0, sum((i + 1) ** 2 * x for i, x in enumerate(d)) - sum((i + 1) * x for i, x in enumerate(d)) ** 2)) for d in (p, q)]
    cp, cq = np.cumsum(p), np.cumsum(q)
    bound = (lambda x, y: min(x, y)) if c >= 0 else (lambda x, y: max(x + y - 1, 0))
    h = [[bound(cq[i], cp[j]) if i >= 0 and j >= 0 else 0.0 for j in range(-1, n)] for i in range(-1, n)]
    for i in range(n + 1):
        h[0][i] = h[i][0] = 0.0
    reach = sum(h[i + 1][j + 1] - cq[i] * cp[j] for i in range(n) for j in range(n))
    w = c * sd[0] * sd[1] / reach if c and sd[0] * sd[1] > 1e-12 else 0
    ent = lambda xs: -sum(x * math.log2(abs(x)) for x in xs if x)
    joint = ent([w * (h[i + 1][j + 1] - h[i][j + 1] - h[i + 1][j] + h[i][j]) + (1 - w) * q[i] * p[j] for i in range(n) for j in range(n)])
    mutual = ent(p) + ent(q) - joint
    return 2 * mutual / (ent(p) + ent(q)) if mutual else 0


@pytest.mark.parametrize("feature", ["none", "gradient", "dct", "edge"])
def test_fmi_equals_window_by_window(feature):
    stretch = lambda x: (x - x.min()) / (x.max() - x.min()) if x.max() > x.min() else np.ones(9)
    f = np.where(RNG.random(A.shape) < 0.5, A, B)
    fa, fb, ff = (perceptual.FEATURES[feature](x) for x in (A, B, f))
    out = []
    for r in range(A.shape[0] - 2):
        for c in range(A.shape[1] - 2):
            a, b, x = (m[r : r + 3, c : c + 3].ravel(order="F") for m in (fa, fb, ff))
            one = 1 if (a == x).all() else plain_share(stretch(a), stretch(x))
            two = 1 if (b == (x if (a == x).all() else stretch(x))).all() else plain_share(stretch(b), stretch(x))
            out.append((one + two) / 2)
    assert perceptual.fmi(A, B, f, feature) == pytest.approx(np.mean(out), abs=1e-9)


def test_fmi_of_equal_images_is_one_and_small_ones_do_not_fit():
    assert perceptual.fmi(A, A, A, "none") == pytest.approx(1)
    with pytest.raises(ValueError):
        perceptual.fmi(A[:2], B[:2], G[:2])
    with pytest.raises(KeyError):
        perceptual.fmi(A, B, G, "colour")


def test_edges_of_a_step():
    x = np.zeros((8, 12))
    x[:, 6:] = 255
    e = perceptual.sobel_edges(x)
    assert e[1:-1, 6].tolist() == [1] * 6 and e.sum() == 6  # of two equal columns the one whose right neighbour is smaller
    assert not perceptual.sobel_edges(x[:, 2:10]).any()  # two of eight columns: exactly four times the mean, not above
    assert not perceptual.sobel_edges(np.ones((5, 5))).any() and not perceptual.sobel_edges(np.ones((2, 2))).any()


def test_chen_blum_and_chen_varshney():
    x = RNG.integers(0, 256, (48, 40)).astype(float)
    y = RNG.integers(0, 256, (48, 40)).astype(float)
    assert perceptual.chen_blum(x, x, x) == pytest.approx(1)
    assert 0 < perceptual.chen_blum(x, y, (x + y) // 2) < 1
    assert perceptual.chen_varshney(x, x, x) == 0
    assert perceptual.chen_varshney(x, y, y) > perceptual.chen_varshney(x, x, x)
    assert math.isnan(perceptual.chen_varshney(np.full((16, 16), 3.0), x[:16, :16], y[:16, :16]))
    # blocks at the end are filled with zeros
    assert perceptual._blocks(np.ones((17, 16)), 16).tolist() == [[256], [16]]
    # the filter over a zero border, by its definition
    taps = np.array([1.0, 2, 3, 2, 1])
    p = np.pad(x, 2)
    assert np.allclose(perceptual._same(x, taps), [[(np.outer(taps, taps) * p[i : i + 5, j : j + 5]).sum() for j in range(40)] for i in range(48)])


def test_lightness_order_error_equals_all_pairs():
    raw, other = A[:6, :5], B[:6, :5]
    n = 20
    pick = [np.floor(np.linspace(1, k, n) + 0.5).astype(int) - 1 for k in raw.shape]
    x, y = raw[np.ix_(*pick)].ravel(), other[np.ix_(*pick)].ravel()
    want = sum(((x >= p) != (y >= q)).sum() for p, q in zip(x, y)) / n**2
    assert perceptual.lightness_order_error(raw, other, n) == want
    assert perceptual.lightness_order_error(raw, raw) == 0


def test_scores_of_image_rows(spark):
    rows = [(1, 12, 14, A.ravel().tolist(), B.ravel().tolist(), G.ravel().tolist()), (2, 2, 2, *[[1.0, 2.0, 3.0, 4.0]] * 3)]
    img = spark.createDataFrame(rows, "img long, h int, w int, a array<double>, b array<double>, f array<double>")
    got = {r["img"]: r for r in windowed.score(img, "FMI", "QCV", "LOE_A").collect()}
    assert got[1]["FMI"] == pytest.approx(perceptual.fmi(A, B, G)) and got[2]["FMI"] is None and got[2]["LOE_A"] == 0


def test_daubechies_taps():
    assert wavelet.daubechies(1) == pytest.approx([math.sqrt(0.5)] * 2)
    s = math.sqrt(3)
    assert wavelet.daubechies(2) == pytest.approx(np.array([1 + s, 3 + s, 3 - s, 1 - s]) / (4 * math.sqrt(2)))
    for order in range(1, 11):
        t = wavelet.daubechies(order)
        assert [t[: len(t) - 2 * k] @ t[2 * k :] for k in range(order)] == pytest.approx([1] + [0] * (order - 1), abs=1e-6)
    with pytest.raises(ValueError):
        wavelet.daubechies(0)


@pytest.mark.parametrize("order,levels,shape", [(1, 1, (8, 8)), (1, 3, (9, 7)), (2, 2, (16, 13)), (4, 2, (33, 20)), (4, 3, (5, 64))])
def test_wavelets_give_the_image_back(order, levels, shape):
    x = RNG.random(shape)
    parts = wavelet.decompose(x, order, levels)
    assert parts[-1][0].shape == tuple((n + 2 * order - 1) // 2 for n in shape)
    assert np.allclose(wavelet.compose(parts, order)[: shape[0], : shape[1]], x)


def test_one_level_of_order_one_is_haar(spark):
    rows = [(1, 12, 14, A.ravel().tolist(), B.ravel().tolist()), (2, 3, 5, A[:3, :5].ravel().tolist(), B[:3, :5].ravel().tolist())]
    img = spark.createDataFrame(rows, "img long, h int, w int, a array<double>, b array<double>")
    pix = {(r["img"], r["r"], r["c"]): r["fused"] for r in fusion.haar(raster.pixels(img, "a", "b")).collect()}
    for r in wavelet.fuse_wavelet(img, 1, 1).collect():
        assert [pix[r["img"], i // r["w"], i % r["w"]] for i in range(r["h"] * r["w"])] == r["fused"]


def test_files_go_out_and_come_back(spark, tmp_path):
    img = spark.createDataFrame([("x", 12, 14, A.ravel().tolist())], "img string, h int, w int, fused array<double>")
    files.write_files(files.encoded(img, "pgm"), str(tmp_path / "p5"))
    files.write_files(files.encoded(img, "pgm-ascii"), str(tmp_path / "p2"))
    files.write_files(files.encoded(img), str(tmp_path / "png"))
    for d in ("p5", "p2"):
        got = files.read_pgm(spark, str(tmp_path / d)).first()
        assert (got["h"], got["w"], got["px"]) == (12, 14, A.ravel().tolist())
    back = raster.read_images(spark, str(tmp_path / "png")).first()
    assert (back["h"], back["w"], back["channels"], bytes(back["data"])) == (12, 14, 1, A.astype(np.uint8).tobytes())
    red = spark.createDataFrame([("y", 1, 2, [255.0, 0.0, 0.0, 1.0, 2.0, 3.0])], "img string, h int, w int, fused array<double>")
    files.write_files(files.encoded(red), str(tmp_path / "rgb"))
    assert bytes(raster.read_images(spark, str(tmp_path / "rgb")).first()["data"]) == bytes([0, 0, 255, 3, 2, 1])


def test_odd_pgm_files():
    assert files.decode_pgm(b"P2\n# note\n2 2 # wide, high\n255\n1 2\n3 4").tolist() == [[1, 2], [3, 4]]
    with pytest.warns(UserWarning):
        assert files.decode_pgm(b"P5 2 2 255\n\x01\x02\x03").tolist() == [[1, 2], [3, 0]]
    assert files.decode_pgm(b"P6 1 1 255\nabc") is None and files.decode_pgm(b"") is None
    assert files.to_levels(np.full((2, 2), 9.0), "auto").tolist() == [[128, 128]] * 2
    assert files.to_levels(np.array([[0.0, 10.0]]), "auto").tolist() == [[0, 255]]
    assert files.level_range(np.array([[0.0, 2.0]]), "auto2") == pytest.approx((1 - 2 * math.sqrt(2), 1 + 2 * math.sqrt(2)))


@pytest.mark.parametrize("space", ["ycbcr", "hsi"])
def test_colour_fusion_of_image_rows(spark, space):
    light = lambda r, g, b: 0.299 * r + 0.587 * g + 0.114 * b
    r, g, b = (RNG.integers(60, 200, (12, 14)).astype(float) for _ in range(3))
    img = spark.createDataFrame([(1, 12, 14, A.ravel().tolist(), *(x.ravel().tolist() for x in (r, g, b)))], "img long, h int, w int, grey array<double>, red array<double>, green array<double>, blue array<double>")
    # one level of order one is the fusion on pixels
    pix = {(x["r"], x["c"]): (x["red"], x["green"], x["blue"]) for x in fusion.fuse_color(raster.pixels(img, "grey", "red", "green", "blue"), space).collect()}
    row = fusion.fuse_color_images(img, space, "wavelet", 1, 1).first()
    assert [pix[i // 14, i % 14] for i in range(168)] == list(zip(row["red"], row["green"], row["blue"]))
    if space == "ycbcr":
        for method in ("laplacian", "fuzzy"):
            out = fusion.fuse_color_images(img, space, method).first()
            assert len(out["red"]) == 168 and all(0 <= x <= 255 for x in out["red"])
        y = np.maximum(A, light(r, g, b))
        cr = np.round(0.5 * r - 0.418688 * g - 0.081312 * b + 128, 9) - 128
        assert out["red"] == np.trunc(np.clip(np.round(y, 9) + 1.402 * cr, 0, 255)).ravel().tolist()
    with pytest.raises(ValueError):
        fusion.fuse_color_images(img, space, "none")


@pytest.mark.parametrize("space, shift", [("hsi", (40, -10, -30)), ("ycbcr", (0, 0, 0))])
def test_details_that_tie_but_for_rounding_come_from_the_first(spark, space, shift):
    # the brightness is the negative of the grey image up to its rounding: every detail of one is minus the other's
    rng = np.random.default_rng(4)
    tiles = [rng.integers(100, 156, 64) for _ in range(8)]
    rows = [(i, 8, 8, *(x.astype(float).tolist() for x in (t, *(255 - t + k for k in shift)))) for i, t in enumerate(tiles)]
    img = spark.createDataFrame(rows, "img long, h int, w int, grey array<double>, red array<double>, green array<double>, blue array<double>")
    out = fusion.fuse_color_images(img, space, "laplacian").collect()
    assert len(out) == 8
    for x in out:  # grey's details on one low-pass level: a constant apart, less what is cut off on the way back
        light = np.mean([x["red"], x["green"], x["blue"]], 0)
        assert np.ptp(light - tiles[x["img"]]) < 1 + 1e-6
