"""Window metrics as relations against the same metrics on whole arrays."""

import numpy as np
import pytest
import window_scores as arrays
from pyspark.sql import functions as F

from lumenfuse.operators import similarity, windowed

RNG = np.random.default_rng(7)
SCHEMA = "img string, h int, w int, a array<double>, b array<double>, f array<double>"


def image(name, h, w, kind):
    """Sources and fused image of whole grey levels: noise, ramps, with flat parts, or one source fused to itself."""
    a, b = (RNG.integers(0, 256, (h, w)).astype(float) for _ in "ab")
    if kind == "ramps":
        a, b = np.add.outer(np.arange(h) * 2.0, np.arange(w)), np.add.outer(np.arange(h), (np.arange(w) ** 2) % 97.0)
    f = np.maximum(a, b)
    if kind == "negative":
        f = 255 - a
    if kind == "flat":
        a[: h // 2], b[:, : w // 2], f[: h // 2, : w // 2] = 9.0, 80.0, 80.0
    return name, h, w, *(x.ravel().tolist() for x in (a, b, f))


ROWS = [image("noise", 64, 48, "noise"), image("odd", 49, 51, "noise"), image("ramps", 45, 60, "ramps"), image("negative", 44, 44, "negative"), image("flat", 52, 50, "flat"), image("line", 11, 70, "noise"), image("small", 8, 9, "noise")]


def test_all_scores_equal_those_on_arrays(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    got = {r["img"]: r for r in similarity.score(rows, *similarity.METRICS).collect()}
    assert set(got) == {r[0] for r in ROWS}
    for name, h, w, *channels in ROWS:
        a, b, f = (np.array(x).reshape(h, w) for x in channels)
        for metric in similarity.METRICS:
            least, otherwise = similarity.LEAST.get(metric, (1, None))
            want = arrays.METRICS[metric](a, b, f) if min(h, w) >= least else otherwise
            if want is None:
                assert got[name][metric] is None, (name, metric)
            else:
                assert got[name][metric] == pytest.approx(want, abs=1e-9, nan_ok=True), (name, metric)


def test_identical_images(spark):
    x = RNG.integers(0, 256, 64 * 64).astype(float).tolist()
    r = similarity.score(spark.createDataFrame([("x", 64, 64, x, x, x)], SCHEMA), *similarity.METRICS).first()
    for metric in similarity.METRICS:
        assert r[metric] == pytest.approx(2 if metric == "VIF" else 1, abs=1e-3), metric


def test_no_pixel_is_lost_or_crosses_images(spark):
    """Scores of an image do not depend on what else is in the table."""
    rows = spark.createDataFrame(ROWS, SCHEMA)
    alone = similarity.score(rows.where("img = 'odd'"), "SSIM", "VIFF", "Qe").first()
    beside = similarity.score(rows, "SSIM", "VIFF", "Qe").where("img = 'odd'").first()
    assert list(alone)[1:] == pytest.approx(list(beside)[1:], abs=1e-12)


def test_nulls_empty_tables_and_wrong_lengths(spark):
    rows = spark.createDataFrame([("n", 8, 8, None, [1.0] * 64, [1.0] * 64), ("s", None, 8, [1.0] * 64, [1.0] * 64, [1.0] * 64)], SCHEMA)
    for r in similarity.score(rows, *similarity.METRICS).collect():
        assert list(r)[1:] == [None] * len(similarity.METRICS)
    assert similarity.score(rows.limit(0), "SSIM", "VIF").count() == 0
    with pytest.raises(Exception, match="reshape"):
        similarity.score(rows.where("img = 'n'").withColumn("a", F.array(F.lit(1.0))), "SSIM").collect()
    with pytest.raises(ValueError):
        windowed.score(rows, "no such metric")


def test_no_python_worker_and_one_shuffle_of_pixels(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA)
    for family in similarity.FAMILIES.values():
        plan = family(similarity.from_images(rows))._jdf.queryExecution().executedPlan().toString()
        assert "ArrowPython" not in plan and "MapInArrow" not in plan
        assert plan.count("Exchange hashpartitioning(img") == plan.count("REPARTITION_BY_NUM") > 0
