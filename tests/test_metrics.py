"""Worked matrices, identities and edge cases of the quality metrics."""

from decimal import Decimal

import numpy as np
import pytest
import window_scores

from lumenfuse.operators import fusion, metrics, report

M3 = {"a": [80, 20, 85, 75, 25, 78, 80, 22, 88], "b": [30, 110, 35, 28, 120, 32, 26, 115, 30], "f": [58, 70, 60, 55, 78, 57, 62, 75, 61]}
WANT = {  # worked by hand for the 3 x 3 matrices
    "EN": 3.169925001, "OCE": 0.0, "MI": 5.895405558, "NMI": 1.927350198, "MLI": 0.067655236, "MSE": 0.018031526, "PSNR": 65.570478703, "SF": 17.004901254, "SD": 7.803133274, "AG": 19.449614059,
    "CC": 0.025932083, "SCD": 1.980082856, "EI": 45.713835851, "QTE": -0.576113392, "rSFe": -0.800260498, "NCIE": 0.823560477, "QABF": 0.277332268, "LABF": 0.722528053, "NABF": 0.000139678, "NABF1": 0.000279357,
}
ALL = (metrics.information, metrics.cross_entropy, metrics.moments, metrics.correlations, metrics.spatial_frequency, metrics.average_gradient, metrics.edge_intensity, metrics.ratio_spatial_frequency, metrics.tsallis, metrics.ncie, metrics.edge_transfer)


def triplet(spark, m, w):
    return spark.createDataFrame([(1, i // w, i % w, *map(float, v)) for i, v in enumerate(zip(m["a"], m["b"], m["f"]))], "img int, r int, c int, a double, b double, f double")


def test_worked_matrices(spark):
    got = {}
    for f in ALL:
        got |= f(triplet(spark, M3, 3)).first().asDict()
    for k, v in WANT.items():
        assert got[k] == pytest.approx(v, abs=1e-8), k
    assert metrics.tsallis(triplet(spark, M3, 3), as_is=False).first()["QTE"] == pytest.approx(-0.266835429, abs=1e-8)


def test_flat_images_do_not_fail(spark):
    flat = triplet(spark, {k: [7] * 6 for k in "abf"}, 3)
    for f in ALL:
        assert f(flat).count() == 1
    assert metrics.correlations(flat).first()["CC"] is None


def test_identities():
    x = np.random.default_rng(1).integers(0, 256, (64, 64)).astype(float)
    assert window_scores.ssim(x, x, x) == pytest.approx(1)
    assert window_scores.vif(x, x, x) == pytest.approx(2)
    assert window_scores.viff(x, x, x) == pytest.approx(1, abs=1e-6)
    assert window_scores.ms_ssim(x[:20, :20], x[:20, :20], x[:20, :20]) == float("-inf")


def test_fusions(spark):
    m = {"a": [10, 200, 30, 40, 50, 60, 70, 80, 90], "b": [10, 20, 30, 240, 50, 60, 70, 80, 90], "f": [0] * 9}
    pix = triplet(spark, m, 3)
    for mode in fusion.FUSIONS:
        rows = {(r["r"], r["c"]): r["fused"] for r in fusion.fuse(pix, mode).collect()}
        assert len(rows) == 9, mode
        assert rows[(2, 2)] == 90, mode
    with pytest.raises(ValueError):
        fusion.fuse(pix, "none")


def test_colour_fusion(spark):
    grey = [[10, 20, 30], [40, 50, 60], [70, 80, 90]]
    cells = [(1, r, c, float(grey[r][c]), float(grey[r][c]), float(grey[r][c]), float(grey[r][c])) for r in range(3) for c in range(3)]
    pix = spark.createDataFrame(cells, "img int, r int, c int, grey double, red double, green double, blue double")
    for space in fusion.SPACES:  # an image fused with itself stays, up to one level cut off on the way back
        out = fusion.fuse_color(pix, space).collect()
        assert len(out) == 9
        for x in out:
            assert all(grey[x["r"]][x["c"]] - x[k] in (0, 1) for k in ("red", "green", "blue")), (space, x)
    assert fusion.fuse_color(pix.limit(0), "hsi").count() == 0
    with pytest.raises(ValueError):
        fusion.fuse_color(pix, "none")


def test_gain_and_common_part_add_up(spark):
    got = metrics.fusion_gain(triplet(spark, M3, 3)).first()
    assert got["QDELTA"] + got["QCOMMON"] == pytest.approx(WANT["QABF"], abs=1e-8)
    flat = triplet(spark, {k: [7] * 6 for k in "abf"}, 3)
    assert metrics.native_scores(flat).count() == 1 and metrics.edge_transfer_first(flat).count() == 1


def test_average_row_skips_nan(spark):
    rows = spark.createDataFrame([("m", "1.png", 1.0), ("m", "2.png", float("nan")), ("m", "3.png", 3.0)], "Model string, ImageName string, SD double")
    got = {r["ImageName"]: r["SD"] for r in report.with_average(rows, ["SD"]).collect()}
    assert got["AVERAGE"] == 2.0 and len(got) == 4


def test_queries_match_duckdb(spark, tmp_path):
    import duckdb
    import os

    from lumenfuse.plans import queries as q

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in ("embeddings", "events"):
        con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    names = ("metric_information", "metric_qabf", "metric_qabf_first", "fuse_haar", "fuse_laplacian", "fuse_wavelet_db4", "fuse_color_ycbcr", "fuse_color_hsi", "color_hsi", "cohort_band_join", "evaluate_tiles", "filter_corr_down", "synth_sine")
    plain = lambda v: None if v is None else round(float(v), 5) + 0.0 if isinstance(v, (float, Decimal)) else str(v)
    for name in names:
        result = con.execute(q.ORACLES[name])
        columns = sorted(c[0] for c in result.description)
        at = [[c[0] for c in result.description].index(c) for c in columns]
        want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=str)
        got = q.QUERIES[name](spark, d)
        assert sorted(got.columns) == columns, name
        assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=str) == want, name
