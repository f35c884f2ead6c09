import numpy as np
import pytest

from rasterlake.operators import manifests, metrics, stencil, training

EPS = 2.0**-52


def frame(spark, *pairs):
    rows = [(i, "m", "d", 0, *np.shape(p), [int(v) for v in np.ravel(p)], [int(v) for v in np.ravel(g)]) for i, (p, g) in enumerate(pairs)]
    return metrics.prepare(spark.createDataFrame(rows, "img_id long, method string, dataset string, class int, h int, w int, pred array<int>, gt array<int>"))


def alignment(p, g, t):
    """E by its definition, pixel by pixel."""
    b, g = (p >= t).astype(float), g.astype(float)
    if not g.any():
        e = 1 - b
    elif g.all():
        e = b
    else:
        x, y = b - b.mean(), g - g.mean()
        e = (2 * x * y / (x * x + y * y + EPS) + 1) ** 2 / 4
    return e.sum() / (g.size - 1 + EPS)


MIXED = np.where(np.arange(36).reshape(6, 6) % 5 < 2, 255, 0)
EMPTY, FULL = np.zeros((6, 6), int), np.full((6, 6), 255)
NOISE = (np.arange(36).reshape(6, 6) * 37) % 251


def test_perfect_prediction(spark):
    df = frame(spark, (MIXED, MIXED))
    assert metrics.mae(df).first().mae == 0
    assert metrics.adaptive(df).first().adp_fm == pytest.approx(1)


def test_empty_and_full_masks(spark):
    df = frame(spark, (NOISE, EMPTY), (NOISE, FULL))
    mean = (NOISE / 255 - NOISE.min() / 255).mean() / ((NOISE.max() - NOISE.min()) / 255)
    sm = {r.img_id: r.sm for r in metrics.structure(df).collect()}
    assert sm[0] == pytest.approx(1 - mean) and sm[1] == pytest.approx(mean)
    assert {r.img_id: r.wfm for r in metrics.weighted(df).collect()}[0] == 0
    assert {r.img_id: r.adp_fm for r in metrics.adaptive(df).collect()}[0] == 0


def test_single_foreground_pixel_has_no_structure(spark):
    one = EMPTY.copy()
    one[2, 3] = 255
    assert metrics.structure(frame(spark, (NOISE, one))).first().sm == 0


def test_alignment_curve_by_definition(spark):
    for g in (MIXED, EMPTY, FULL):
        df = frame(spark, (NOISE, g))
        p = np.array(df.first().p).reshape(6, 6)
        got = {r.k: r.em for r in metrics.curves(df).collect()}
        assert len(got) == 256
        cut = np.floor(p * 255)
        for k in (0, 10, 100, 254):
            assert got[k] == pytest.approx(alignment(cut, g > 128, 255 - k), abs=1e-9)


def test_curve_is_monotone(spark):
    rows = sorted(metrics.curves(frame(spark, (NOISE, MIXED))).collect(), key=lambda r: r.k)
    assert rows[-1].ps == 36 and all(a.ps <= b.ps and a.recall <= b.recall for a, b in zip(rows, rows[1:], strict=False))


def test_nearest_foreground_by_brute_force():
    rng = np.random.default_rng(0)
    for shape in ((1, 1), (5, 9), (12, 7)):
        g = rng.random(shape) < 0.2
        g[0, 0] = True
        d2, ny, nx = metrics.nearest_foreground(g)
        points = np.argwhere(g)
        for y, x in np.ndindex(shape):
            best = min(((y - a) ** 2 + (x - b) ** 2, a, b) for a, b in points.tolist())
            assert (d2[y, x], ny[y, x], nx[y, x]) == best


def test_flip_keeps_scores(spark):
    df = frame(spark, (NOISE, MIXED), (NOISE[:, ::-1], MIXED[:, ::-1]))
    a, b = metrics.adaptive(df).orderBy("img_id").collect()
    assert a.adp_fm == pytest.approx(b.adp_fm) and a.adp_em == pytest.approx(b.adp_em)


def test_dice_of_a_perfect_match(spark):
    k = int((MIXED > 0).sum())
    assert metrics.overlaps(frame(spark, (MIXED, MIXED))).first().dice_loss == pytest.approx(-1 / (2 * k + 1))


def test_positions_over_many_partitions(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS id").repartition(9)
    assert [(r.id, r["rank"]) for r in manifests.ranked(df, "id").orderBy("id").collect()] == [(i, i) for i in range(1000)]


def test_upsert_and_schedule(spark):
    from pyspark.sql import functions as F

    old, new = spark.createDataFrame([("a", 1), ("b", 1)], "name string, v int"), spark.createDataFrame([("b", 2)], "name string, v int")
    assert sorted(map(tuple, manifests.upsert(old, new, "name").collect())) == [("a", 1), ("b", 2)]
    lr, want = 1.0, []
    for e in range(1, 8):
        lr *= 0.1 ** (e // 3)
        want.append(lr)
    got = [r.lr for r in spark.range(1, 8).select(training.learning_rate(F.col("id").cast("int"), 1.0, 0.1, 3).alias("lr")).collect()]
    assert got == pytest.approx(want)


def test_resize_to_the_same_size_is_the_identity(spark):
    from pyspark.sql import functions as F

    df = frame(spark, (NOISE, MIXED))
    for corners in (True, False):
        r = df.select("p", stencil.resize(F.col("p"), F.col("h"), F.col("w"), 6, 6, corners).alias("v")).first()
        assert r.v == pytest.approx(r.p)


def test_stream(spark, tmp_path):
    from rasterlake.streaming.evaluate import mae_stream

    raw = frame(spark, (NOISE, MIXED), (MIXED, MIXED)).select("img_id", "method", "dataset", "class", "h", "w", "pred", "gt")
    raw.write.parquet(str(tmp_path / "in"))
    q = mae_stream(spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("scores").start()
    q.processAllAvailable()
    q.stop()
    row = spark.table("scores").first()
    assert row.images == 2 and row.mae > 0


def test_files(spark, tmp_path):
    from rasterlake.sources import rasters

    for n in ("a.jpg", "b.png", "c.JPG", "d.tif"):
        (tmp_path / n).write_bytes(bytes([1, 2, 3, 4]))
    assert {r.name for r in rasters.scan_files(spark, str(tmp_path)).collect()} == {"a.jpg", "b.png"}
    got = rasters.decode_files(spark, str(tmp_path), lambda b: (2, 2, list(b))).collect()
    assert {r.name for r in got} == {"a.jpg", "b.png"} and got[0].px == [1, 2, 3, 4]


def png(px: np.ndarray) -> bytes:
    """An 8-bit PNG, grey or red-green-blue."""
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    h, w = px.shape[:2]
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if px.ndim == 2 else 2, 0, 0, 0)
    rows = b"".join(b"\0" + r.astype(np.uint8).tobytes() for r in px)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_image_files(spark, tmp_path):
    from rasterlake.sources import rasters

    grey = np.arange(12).reshape(3, 4) * 20
    colour = np.zeros((2, 2, 3), int)
    colour[0, 0], colour[0, 1], colour[1, 0] = (255, 0, 0), (0, 255, 0), (0, 0, 255)
    for folder in ("pred", "gt"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "a.png").write_bytes(png(grey if folder == "pred" else (grey > 100) * 255))
    (tmp_path / "pred" / "b.png").write_bytes(png(colour))
    (tmp_path / "pred" / "c.png").write_bytes(b"not an image")
    (tmp_path / "pred" / "d.txt").write_bytes(png(grey))
    got = {r.name: r for r in rasters.grey_files(spark, str(tmp_path / "pred")).collect()}
    assert set(got) == {"a.png", "b.png"}
    assert (got["a.png"].h, got["a.png"].w, got["a.png"].px) == (3, 4, grey.ravel().tolist())
    assert got["b.png"].px == [76, 150, 29, 0]
    pairs = metrics.prepare(rasters.file_pairs(spark, str(tmp_path / "pred"), str(tmp_path / "gt"), "m", "d"))
    assert metrics.mae(pairs).first().mae == pytest.approx(np.abs(grey / 220 - (grey > 100)).mean())


def test_attention_kernel_by_one_pixel(spark):
    taps = np.array(stencil.attention_taps(5, 2.0))
    one = np.zeros((6, 6), int)
    one[2, 3] = 255
    got = np.array(stencil.separable_blur(frame(spark, (one, MIXED)), "p", "v", taps.tolist()).first().v).reshape(6, 6)
    want = np.zeros((10, 10))
    want[2:7, 3:8] = np.outer(taps, taps)
    assert taps.sum() == pytest.approx(1) and np.allclose(got, want[2:8, 2:8])


def test_report_sinks(spark, tmp_path):
    from rasterlake.sources import sinks

    df = frame(spark, (NOISE, MIXED), (MIXED, MIXED))
    report = metrics.report(df, "dataset", "method")
    sinks.write_report(report, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 1
    assert sinks.report_text(report).count("\n") == 1
    sinks.write_masks(df, str(tmp_path / "m"))
    assert set(spark.read.parquet(str(tmp_path / "m")).orderBy("img_id").collect()[1].px) == {0, 255}


def test_inference_slot(spark):
    df = frame(spark, (NOISE, MIXED), (MIXED, MIXED)).withColumn("p", stencil.F.col("p").cast("array<float>"))
    rows = training.predict(df, lambda: lambda x: x * 2 - 1, "p", "logit", [36], batch=1).orderBy("img_id").collect()
    assert rows[1].logit == pytest.approx([2 * v - 1 for v in rows[1].p])
