"""Samples, percentile ranges, parents in wavelet trees, and the PGM data source."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfuse.operators import bands, points, stats
from lumenfuse.operators.filter_banks import named
from lumenfuse.sources import files, pgm_source, raster

RNG = np.random.default_rng(9)


def pixels(spark, images):
    return spark.createDataFrame([(i, r, c, float(v)) for i, x in images.items() for (r, c), v in np.ndenumerate(x)], "img long, r int, c int, v double")


def test_samples_are_even_whole_and_the_same_again(spark):
    pix = pixels(spark, {1: RNG.integers(0, 9, (40, 30)), 2: RNG.integers(0, 9, (7, 5)), 3: np.ones((1, 1))})
    once = sorted(map(tuple, stats.sample_union(pix, 300).collect()))
    assert once == sorted(map(tuple, stats.sample_union(pix.repartition(7), 300).collect()))
    assert len(set(once)) == len(once) == 100 + 35 + 1 and set(once) <= set(map(tuple, pix.collect()))
    assert stats.sample_union(pix, 1).groupBy("img").count().agg(F.max("count")).first()[0] == 1
    assert once != sorted(map(tuple, stats.sample_union(pix, 300, seed=1).collect()))
    rows = {k: np.array([r for i, r, _, _ in once if i == k]).mean() for k in (1,)}
    assert 14 < rows[1] < 25  # of 40 rows, not the first ones
    assert stats.sample_union(pix.limit(0), 10).count() == 0


def by_hand(x, share=0.1, bins=101):
    """Counts about the mean, their running sum, and straight lines between the edges of bins."""
    width = (x.max() - x.min()) / bins
    if not width:
        return x.mean() - 0.5, x.mean() + 0.5
    k = np.sign(x - x.mean()) * np.floor(np.abs(x - x.mean()) / width + 0.5)
    bin_of = np.arange(k.min(), k.max() + 1)
    upto = np.concatenate(([0], np.cumsum([(k == b).sum() + 1e-10 for b in bin_of])))
    edges = x.mean() + width * (np.concatenate(([bin_of[0] - 1], bin_of)) + 0.5)
    p, q = np.interp([share, 1 - share], upto / upto[-1], edges)
    return (p + q) / 2 - (q - p) / 2 / (1 - 2 * share), (p + q) / 2 + (q - p) / 2 / (1 - 2 * share)


def test_percentile_range(spark):
    images = {1: RNG.normal(size=(37, 29)) * 40, 2: RNG.gamma(1.0, 9.0, (19, 23)), 3: np.full((3, 3), 7.0)}
    got = {r["img"]: (r["lo"], r["hi"]) for r in points.percentile_range(pixels(spark, images)).collect()}
    for i, x in images.items():
        assert np.allclose(got[i], by_hand(x), atol=1e-6), i
        assert np.allclose(files.level_range(x, "auto3"), by_hand(x), atol=1e-6), i
    assert points.percentile_range(pixels(spark, images).limit(0)).count() == 0


def test_parents_equal_a_loop(spark):
    images = spark.createDataFrame([(i, 16, 24, RNG.normal(size=384).tolist()) for i in range(2)], "img long, h int, w int, a array<double>")
    pyr = bands.qmf_pyramid(bands.from_images(images, "a"), 3, named("qmf5")).cache()
    at = {(r["img"], r["level"], r["band"], r["r"], r["c"]): r["a"] for r in pyr.collect()}
    tree = bands.with_parents(pyr).collect()
    assert len(tree) == sum(k[2] > 0 for k in at)
    for t in tree:
        assert t["parent_a"] == at.get((t["img"], t["level"] + 1, t["band"], t["r"] // 2, t["c"] // 2))
    assert {t["level"] for t in tree if t["parent_a"] is None} == {3}


def test_pgm_files_are_a_data_source(spark, tmp_path):
    pgm_source.register(spark)
    top = str(tmp_path / "out")
    kept = {f"{i}": RNG.integers(0, 256, (5 + i, 9)) for i in range(7)}
    rows = lambda images: spark.createDataFrame([(k, *x.shape, x.astype(float).ravel().tolist()) for k, x in images.items()], "img string, h int, w int, px array<double>").repartition(3)
    rows(kept).write.format("pgm").option("levels", "0,255").mode("append").save(top)
    assert sorted(os.listdir(top)) == [f"{i}.pgm" for i in range(7)]
    back = spark.read.format("pgm").option("filesPerPartition", 2).load(top)
    assert back.rdd.getNumPartitions() == 4
    for r in back.collect():
        assert np.array_equal(np.array(r["px"]).reshape(r["h"], r["w"]), kept[os.path.basename(r["path"])[:-4]])
    # a task that fails, and two images of one name, leave what was there
    fails = rows(kept | {"8": RNG.integers(0, 9, (4, 4))}).withColumn("h", F.when(F.col("img") == "8", 3).otherwise(F.col("h")))
    for bad in (fails, rows(kept).union(rows({"1": kept["1"]}))):
        with pytest.raises(Exception):
            bad.write.format("pgm").mode("append").save(top)
        assert sorted(os.listdir(top)) == [f"{i}.pgm" for i in range(7)]
    rows({"x": kept["2"]}).write.format("pgm").option("ascii", "true").option("levels", "auto3").mode("overwrite").save(top)
    assert os.listdir(top) == ["x.pgm"]
    with open(f"{top}/x.pgm", "rb") as f:
        assert np.array_equal(files.decode_pgm(f.read()), files.to_levels(kept["2"].astype(float), "auto3"))
    with open(f"{top}/y.PGM", "wb") as f:
        f.write(b"no image")
    assert spark.read.format("pgm").load(top).count() == 1
    with pytest.raises(Exception):
        rows(kept).drop("h").write.format("pgm").mode("append").save(top)


def test_catalogue_and_upper_case_names(spark, tmp_path):
    top = str(tmp_path)
    os.makedirs(f"{top}/set/MRI")
    for n in ("b.PNG", "a.png", "c.Jpg", "note.txt", "png"):
        with open(f"{top}/set/MRI/{n}", "wb") as f:
            f.write(files.encode_png(np.full((4, 4), 7, np.uint8)))
    got = [(r["name"], r["kind"]) for r in files.catalogue(spark, f"{top}/set", f"{top}/set/MRI").collect()]
    assert got == [("a.png", "png"), ("b.PNG", "png"), ("c.Jpg", "jpg")]
    assert files.catalogue(spark, top).first()["bytes"] > 60
    assert {r["img"] for r in raster.read_images(spark, f"{top}/set").select("img").collect()} == {"a.png", "b.PNG"}
