"""Fusion and evaluation of folders of images: pairing, skip reports, decoding, tables, cohort files."""

import csv
import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfuse.operators import cohort
from lumenfuse.plans import batch, evaluate
from lumenfuse.sources import files, raster

RNG = np.random.default_rng(4)


def put(path, x):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(files.encode_png(x.astype(np.uint8)))


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """Three pairs, one grey image without a partner, two methods with an image too many."""
    top = str(tmp_path_factory.mktemp("images"))
    grey, colour = {}, {}
    for n in ("1.png", "2.png", "3.png"):
        grey[n], colour[n] = RNG.integers(0, 256, (48, 52)), RNG.integers(0, 256, (48, 52, 3))
        put(f"{top}/set/MRI/{n}", grey[n])
        put(f"{top}/set/PET/{n}", colour[n])
        for m in ("one", "two"):
            put(f"{top}/fused/{m}/{n}", (np.maximum if m == "one" else np.minimum)(grey[n], colour[n][..., 0]))
    put(f"{top}/set/MRI/4.png", grey["1.png"])
    put(f"{top}/set/ALL_FUSED/1.png", grey["1.png"])
    put(f"{top}/fused/two/9.png", grey["1.png"])
    return top, grey, colour


def test_images_are_decoded(spark, folders):
    top, grey, colour = folders
    images = raster.read_images(spark, f"{top}/set")
    assert raster.source_roles(images) == ["MRI", "PET"]
    with pytest.raises(ValueError):
        raster.source_roles(images.where("role = 'MRI'"))
    for r in raster.colour_images(images.where("role = 'PET'")).collect():
        assert np.array_equal(np.stack([r["red"], r["green"], r["blue"]], 1).reshape(48, 52, 3), colour[r["img"]])
    for r in raster.grey_images(images).where("role in ('MRI', 'PET') and img <> '4.png'").collect():
        x = colour[r["img"]].astype(float)
        want = grey[r["img"]] if r["role"] == "MRI" else np.floor(x @ [0.2989, 0.5870, 0.1140] + 0.5)
        assert np.abs(np.array(r["px"]).reshape(48, 52) - want).max() < 1e-9
    means = raster.grey_images(images.where("role = 'PET'"), "mean").where("img = '1.png'").first()
    assert np.allclose(np.array(means["px"]).reshape(48, 52), colour["1.png"].mean(2))
    assert raster.grey_images(images.limit(0)).count() == 0


def test_levels_of_either_scale(spark):
    d = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 255.0])], "img int, px array<double>")
    assert {r["img"]: r["px"] for r in raster.to_scale(d, "px").collect()} == {1: [0.0, 255.0], 2: [0.0, 255.0]}
    assert {r["img"]: r["px"] for r in raster.to_scale(d, "px", 1.0).collect()} == {1: [0.0, 1.0], 2: [0.0, 1.0]}


def test_a_folder_is_fused(spark, folders, tmp_path):
    top, grey, colour = folders
    fused, skipped = batch.fuse_folder(spark, f"{top}/set", f"{tmp_path}/out", "grayscale", "fuzzy", "MRI", "PET")
    assert [r["img"] for r in skipped.collect()] == ["4.png"]
    assert sorted(os.path.basename(p) for p in glob.glob(f"{tmp_path}/out/*.png")) == ["1.png", "2.png", "3.png"]
    back = {r["img"]: np.array(r["px"]).reshape(48, 52) for r in raster.grey_images(raster.read_images(spark, f"{tmp_path}/out")).collect()}
    for n, x in back.items():
        assert np.array_equal(x, np.floor(np.maximum(grey[n], colour[n].mean(2))))
    for mode in ("ycbcr", "hsi"):
        for method in batch.METHODS:
            rows, _ = batch.fuse_folder(spark, f"{top}/set", None, mode, method)
            assert {r["img"]: len(r["red"]) for r in rows.collect()} == {n: 48 * 52 for n in grey}
    batch.fuse_folder(spark, f"{top}/set", f"{tmp_path}/colour", "ycbcr", "wavelet")
    assert raster.read_images(spark, f"{tmp_path}/colour").where("channels = 3").count() == 3
    rows, _ = batch.fuse_folder(spark, f"{top}/set", None, "grayscale", "pca", "MRI", "PET")
    assert {r["img"]: len(r["fused"]) for r in rows.collect()} == {n: 48 * 52 for n in grey}
    with pytest.raises(ValueError):
        batch.fuse_folder(spark, f"{top}/set", None, "ycbcr", "none")
    os.makedirs(f"{tmp_path}/nothing")
    with pytest.raises(ValueError):
        batch.evaluation_rows(spark, f"{top}/set", f"{tmp_path}/nothing")


def test_folders_are_evaluated(spark, folders, tmp_path):
    top, grey, colour = folders
    skipped = batch.evaluate_folders(spark, f"{top}/set", f"{top}/fused", f"{tmp_path}/report")
    # the data set has a folder of fused images too, which is no source
    assert sorted(map(tuple, skipped.collect())) == [("two", "9.png")]
    for m in ("one", "two"):
        (path,) = glob.glob(f"{tmp_path}/report/methods/Model={m}/*.csv")
        rows = list(csv.DictReader(open(path)))
        assert [r["ImageName"] for r in rows] == ["1.png", "2.png", "3.png", "AVERAGE"]
        assert list(rows[0])[1:] == evaluate.COLUMNS
        for c in evaluate.COLUMNS:
            assert float(rows[3][c]) == pytest.approx(np.mean([float(r[c]) for r in rows[:3]]))
        f = [(np.maximum if m == "one" else np.minimum)(grey[r["ImageName"]], colour[r["ImageName"]][..., 0]) for r in rows[:3]]
        assert [float(r["SD"]) for r in rows[:3]] == pytest.approx([x.std() for x in f])
    (path,) = glob.glob(f"{tmp_path}/report/summary/*.csv")
    assert [r["Model"] for r in csv.DictReader(open(path))] == ["one", "two"]


def test_cohort_files(spark, tmp_path):
    d = spark.createDataFrame([("s1", "2020-01-01", "v1", 3), ("s2", None, "v2", 4)], "subject_id string, image_date string, image_visit string, k int")
    cohort.write_cohort(d, f"{tmp_path}/c")
    back = cohort.read_cohort(spark, f"{tmp_path}/c")
    assert dict(back.dtypes)["image_date"] == "date" and sorted((r["subject_id"], r["k"]) for r in back.collect()) == [("s1", 3), ("s2", 4)]
    pet = back.select("subject_id", F.date_add("image_date", 7).alias("image_date"), "image_visit", "k")
    assert [(r["subject_id"], r["date_diff_days"]) for r in cohort.match_by_date(back, pet).collect()] == [("s1", 7)]


def test_a_batch_of_a_stream_that_runs_again_writes_the_same(spark, tmp_path):
    from lumenfuse.streaming import drop_folder

    d = spark.createDataFrame([(1, 1, 2, [1.0, 5.0])], "img long, h int, w int, px array<double>")
    d.write.parquet(f"{tmp_path}/in")
    metric = lambda df: df.select("img", F.array_max("px").alias("top"))
    for k in range(2):  # a new checkpoint: the same batch once more
        q = drop_folder.score_stream(spark, f"{tmp_path}/in", "img long, h int, w int, px array<double>", metric, f"{tmp_path}/out", f"{tmp_path}/cp{k}")
        q.awaitTermination()
    assert [(r["img"], r["top"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [(1, 5.0)]
