"""Raster pairs and manifests from tables, and file sources for real image trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.functions.once import settled
from rasterlake.operators import manifests, stencil

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def teacher_student(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    """``(img_id, class, e, proto)``: each vector beside the vector with the smallest id of its label. ``where`` picks images by ``img_id`` and ``class`` as they are read."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), F.col("label").alias("class"), F.col("embedding").cast("array<double>").alias("e"))
    proto = v.groupBy("class").agg(F.min_by("e", "img_id").alias("proto"))
    return (v if where is None else v.where(where)).join(F.broadcast(proto), "class")  # a row for each class, of which there are a handful; without the hint a hot class would be sorted in one task


def rasters(spark: SparkSession, sf_dir: str, where: str | None = None) -> DataFrame:
    """Mask pairs ``(img_id, method, dataset, class, h, w, pred, gt)`` with values 0 to 255, one row an image.

    A filter on the result is applied after the pixels are made (``settled``); one in ``where`` reaches the files.
    """
    df = teacher_student(spark, sf_dir, where).withColumn("low", F.array_min("e")).withColumn("high", F.array_max("e")).withColumn("rule", F.pmod("img_id", F.lit(16)).cast("int"))
    df = settled(df.withColumn("least", F.array_position("e", F.col("low")) - 1).withColumn("most", F.array_position("e", F.col("high")) - 1))
    rule = F.col("rule")
    pred = F.transform("e", lambda v: F.when(rule == 7, 128).otherwise(F.floor((v - F.col("low")) / (F.col("high") - F.col("low")) * 255).cast("int")))
    on = F.transform(
        "e",
        lambda v, i: F.when(rule == 0, False)
        .when(rule == 1, True)
        .when(rule == 2, i == F.col("most"))
        .when(rule == 3, i != F.col("least"))
        .when(rule == 4, i >= SIDE * (SIDE - 1))
        .when(rule == 5, (F.floor(i / SIDE) < 2) & (i % SIDE < 2))
        .when(rule == 6, F.floor(i / SIDE).between(2, 5) & (i % SIDE).between(2, 5))
        .otherwise(F.get("proto", i) > 0),
    )
    gt = F.transform(on, lambda b: F.when(b, 255).otherwise(0))
    method = F.concat(F.lit("m"), F.pmod("img_id", F.lit(3)).cast("string"))
    return df.select("img_id", method.alias("method"), F.lit("R").alias("dataset"), "class", F.lit(SIDE).alias("h"), F.lit(SIDE).alias("w"), pred.alias("pred"), gt.alias("gt")).transform(settled)


def scan_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".jpg", ".png")) -> DataFrame:
    """``(path, name, length)`` of the files of a folder with one of the suffixes (case counts), without their contents."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").load(root)
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), "length")


def decode_files(spark: SparkSession, root: str, decoder: Callable[[bytes], tuple[int, int, list[int]]], suffixes: tuple[str, ...] = (".jpg", ".png")) -> DataFrame:
    """``(name, h, w, px)`` with pixels read by ``decoder`` (bytes to height, width and flat values); Arrow batches, no shuffle."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").load(root)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [decoder(c) for c in frame["content"]]
            yield pd.DataFrame({"name": frame["name"], "h": [g[0] for g in got], "w": [g[1] for g in got], "px": [list(g[2]) for g in got]})

    return files.select(F.substring_index("path", "/", -1).alias("name"), "content").mapInPandas(run, "name string, h int, w int, px array<int>")


def luminance(r, g, b):  # noqa: ANN001, ANN201
    """8-bit grey of red, green and blue columns by the usual weights."""
    return F.floor(r * 0.299 + g * 0.587 + b * 0.114 + 0.5).cast("int")


def grey_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".jpg", ".png", ".tif")) -> DataFrame:
    """``(name, h, w, px)`` of image files in 8-bit grey, decoded by Spark's own image source.

    Files that it cannot decode give no row. Colours (stored as blue, green, red) become luminance, and an alpha
    channel is not read. Arrow batches, no shuffle.
    """
    files = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").load(root)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            flat = []
            for data, n in zip(frame["data"], frame["nChannels"], strict=True):
                px = np.frombuffer(data, dtype=np.uint8).reshape(-1, n)
                flat.append(px[:, 0].astype(np.int32) if n == 1 else np.floor(px[:, 2] * 0.299 + px[:, 1] * 0.587 + px[:, 0] * 0.114 + 0.5).astype(np.int32))
            yield pd.DataFrame({"name": frame["name"], "h": frame["height"], "w": frame["width"], "px": flat})

    picked = files.select(F.substring_index("image.origin", "/", -1).alias("name"), "image.height", "image.width", "image.nChannels", "image.data")
    return picked.mapInPandas(run, "name string, h int, w int, px array<int>")


def rgb_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".jpg", ".png")) -> DataFrame:
    """``(name, h, w, channels)`` of image files, ``channels`` being red, green and blue as flat arrays, decoded by Spark's own image source.

    Files that it cannot decode give no row; grey ones have three equal channels, and an alpha channel is not read. Arrow batches, no shuffle.
    """
    files = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", "*{" + ",".join(suffixes) + "}").load(root)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            flat = []
            for data, n in zip(frame["data"], frame["nChannels"], strict=True):
                px = np.frombuffer(data, dtype=np.uint8).reshape(-1, n).astype(np.int32)
                flat.append([px[:, 0]] * 3 if n == 1 else [px[:, 2], px[:, 1], px[:, 0]])
            yield pd.DataFrame({"name": frame["name"], "h": frame["height"], "w": frame["width"], "channels": flat})

    picked = files.select(F.substring_index("image.origin", "/", -1).alias("name"), "image.height", "image.width", "image.nChannels", "image.data")
    return picked.mapInPandas(run, "name string, h int, w int, channels array<array<int>>")


def file_outcomes(spark: SparkSession, pred_root: str, gt_root: str, suffixes: tuple[str, ...] = (".jpg", ".png", ".tif")) -> DataFrame:
    """``(name, outcome)`` of every file of two folders (see ``manifests.pairing``); what cannot be decoded counts as missing."""

    def listed(root: str) -> DataFrame:
        read = grey_files(spark, root, suffixes).select("name", "h", "w")
        return scan_files(spark, root, suffixes).select("name").join(read, "name", "left")

    gt, pred = listed(gt_root), listed(pred_root)
    found = manifests.pairing(gt, pred, "name", ["h", "w"])
    lost = gt.join(pred, "name").where(gt["h"].isNull() & pred["h"].isNull()).select("name", F.lit("not_decoded").alias("outcome"))
    return found.union(lost)


def file_pairs(spark: SparkSession, pred_root: str, gt_root: str, method: str, dataset: str, suffixes: tuple[str, ...] = (".jpg", ".png", ".tif"), classes: list[str] | None = None, nearest: bool = False) -> DataFrame:
    """Mask pairs of two folders by file name, in the form of ``rasters``.

    A prediction of another size than its mask is resized to it, bilinearly or to the ``nearest`` pixel. Files without a partner give no row: ``file_outcomes``
    names them. ``img_id`` is a hash of the name; ``class`` is the first of ``classes`` in the name, null if there is none.
    """
    pred, gt = (grey_files(spark, r, suffixes) for r in (pred_root, gt_root))
    both = settled(gt.withColumnRenamed("px", "gt").join(pred.select("name", F.col("h").alias("ph"), F.col("w").alias("pw"), F.col("px").alias("p")), "name"))
    how = [F.col(c) for c in ("p", "ph", "pw", "h", "w")]
    other = stencil.resize_nearest(*how) if nearest else F.transform(stencil.resize(*how, False), lambda v: F.floor(v + 0.5).cast("int"))
    sized = F.when((F.col("ph") == F.col("h")) & (F.col("pw") == F.col("w")), F.col("p")).otherwise(other)
    of = F.get(manifests.classes_in(F.col("name"), classes), F.lit(0)) if classes else F.lit(None).cast("string")
    return both.select(F.xxhash64("name").alias("img_id"), F.lit(method).alias("method"), F.lit(dataset).alias("dataset"), of.alias("class"), "h", "w", sized.alias("pred"), "gt")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("img_id"), F.concat(F.lit("Image/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("path"), "source", "n_chars")


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("img_id"), F.concat(F.lit("GT/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"), "quality")
