"""Every raster operator on rasters of the size that the models take, within three seconds an image."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.operators import metrics, stencil, training
from rasterlake.sources import rasters, sinks

SIDE, IMAGES = 352, 4


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    y, x = np.divmod(np.arange(SIDE * SIDE), SIDE)
    rows = []
    for k in range(IMAGES):
        gt = ((y - 150) ** 2 + (x - 180) ** 2 < (40 + 10 * k) ** 2) * 255
        pred = np.clip(gt * 0.7 + 40 + 30 * np.sin(x / 9) * np.cos(y / 7) + k, 0, 255).astype(int)
        rows.append((k, "m", "d", "c", SIDE, SIDE, pred.tolist(), gt.tolist()))
    df = spark.createDataFrame(rows, "img_id long, method string, dataset string, class string, h int, w int, pred array<int>, gt array<int>")
    path = str(tmp_path_factory.mktemp("full") / "raw")
    df.repartition(IMAGES).write.parquet(path)
    return spark.read.parquet(path)


def pairs(raw):
    return metrics.prepare(raw)


def doubles(raw):
    return raw.withColumn("s", stencil.stretch(F.col("pred").cast("array<double>"))).withColumn("t", stencil.by_maximum(F.col("gt").cast("array<double>")))


CASES = {
    "stretch": lambda df: df.select(F.sum(F.get(stencil.stretch(F.col("pred").cast("array<double>")), F.lit(7)))),
    "by_maximum": lambda df: df.select(F.sum(F.get(stencil.by_maximum(F.col("gt")), F.lit(7)))),
    "raw_mae": lambda df: metrics.raw_mae(df).select(F.sum("mae")),
    "mae": lambda df: metrics.mae(pairs(df)).select(F.sum("mae")),
    "adaptive": lambda df: metrics.adaptive(pairs(df)).select(F.sum("adp_fm")),
    "curves": lambda df: metrics.curves(pairs(df)).select(F.sum("em")),
    "structure": lambda df: metrics.structure(pairs(df)).select(F.sum("sm")),
    "weighted": lambda df: metrics.weighted(pairs(df)).select(F.sum("wfm")),
    "overlaps": lambda df: metrics.overlaps(df).select(F.sum("iou")),
    "report": lambda df: metrics.report(pairs(df), "dataset", "method"),
    "edges": lambda df: stencil.edges(pairs(df), "p", "v").select(F.sum(F.get("v", F.lit(7)))),
    "edge_loss": lambda df: stencil.edge_loss(doubles(df)).select(F.sum("loss")),
    "structure_loss": lambda df: stencil.structure_loss(pairs(df).withColumn("x", F.transform("p", lambda v: 4 * v - 2))).select(F.sum("loss")),
    "search_attention": lambda df: stencil.search_attention(pairs(df), "p", "p", "v").select(F.sum(F.get("v", F.lit(7)))),
    "resize": lambda df: df.select(F.sum(F.get(stencil.resize(F.col("pred"), F.col("h"), F.col("w"), 200, 300, True), F.lit(7)))),
    "flip": lambda df: df.select(F.sum(F.get(stencil.flip_rows(F.col("pred"), F.col("h"), F.col("w")), F.lit(7)))),
    "pseudo_labels": lambda df: training.pseudo_labels(doubles(df), "t", 0.4).select(F.sum(F.get("label", F.lit(7)))),
    "channels": lambda df: df.select(F.sum(F.get(F.get(stencil.stretch_channels(F.array("pred", "gt", "pred")), F.lit(1)), F.lit(7)))),
    "mask_bytes": lambda df: sinks.mask_bytes(pairs(df)).select(F.sum(F.get("px", F.lit(7)))),
}


@pytest.mark.parametrize("name", list(CASES))
def test_seconds_an_image(raw, name):
    df = CASES[name](raw)
    began = time.time()
    assert df.first() is not None
    assert (time.time() - began) / IMAGES < 3


def test_scores_against_a_smaller_copy_of_the_formulas(raw):
    """Threshold counts by comparing, distances by search: 20 pixels of one image."""
    row = pairs(raw).orderBy("img_id").first()
    p, g = np.array(row.p).reshape(SIDE, SIDE), np.array(row.g).reshape(SIDE, SIDE) > 0
    ps, tp = metrics.thresholds(p, g)
    for k in (0, 1, 100, 200, 255):
        on = np.floor(p * 255) >= 255 - k
        assert (ps[k], tp[k]) == (on.sum(), (on & g).sum())
    d2, ny, nx = metrics.nearest_foreground(g)
    yy, xx = np.nonzero(g)
    for y, x in np.random.default_rng(1).integers(0, SIDE, (20, 2)):
        d = (yy - y) ** 2 + (xx - x) ** 2
        assert d2[y, x] == d.min() and (ny[y, x], nx[y, x]) == min(zip(yy[d == d.min()].tolist(), xx[d == d.min()].tolist(), strict=True))


def test_reports_are_narrow_up_to_the_means(raw):
    plan = metrics.report(pairs(raw), "dataset", "method")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 3 and "Join" not in plan and "Generate" in plan


def test_null_rasters_and_groups(spark):
    rows = [(1, "m", None, "c", 1, 2, [0, 255], [0, 255]), (2, "m", None, "c", 1, 2, None, None), (3, "m", "d", "c", 1, 2, [9, 9], [255, 255])]
    df = metrics.prepare(spark.createDataFrame(rows, "img_id long, method string, dataset string, class string, h int, w int, pred array<int>, gt array<int>"))
    got = {r.dataset: r for r in metrics.report(df, "dataset").collect()}
    assert set(got) == {None, "d"} and got[None].mae == 0 and got["d"].sm == pytest.approx(9 / 255, abs=1e-4)
    assert metrics.structure(df).where("img_id = 2").first().sm is None
    assert metrics.report(df.limit(0), "dataset").count() == 0


def test_resize_to_the_nearest_pixel(spark):
    df = spark.createDataFrame([(2, 3, [1, 2, 3, 4, 5, 6])], "h int, w int, v array<int>")
    got = df.select(stencil.resize_nearest(F.col("v"), F.col("h"), F.col("w"), 4, 6).alias("r")).first().r
    assert got == [1, 1, 2, 2, 3, 3] * 2 + [4, 4, 5, 5, 6, 6] * 2
    assert df.select(stencil.resize_nearest(F.col("v"), F.col("h"), F.col("w"), F.col("h"), F.col("w")).alias("r")).first().r == [1, 2, 3, 4, 5, 6]
    assert rasters.SIDE == 8
