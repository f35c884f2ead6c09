"""Pairing, checking and versioning of image manifests."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterlake.sources import catalogue


def has_suffix(path: Column, *suffixes: str) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | path.endswith(s)
    return out


def output_name(path: Column) -> Column:
    """The file's name; one that ends in .jpg is cut at its first .jpg and becomes .png."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.endswith(".jpg"), F.concat(F.get(F.split(name, r"\.jpg"), F.lit(0)), F.lit(".png"))).otherwise(name)


def classes_in(name: Column, classes: list[str]) -> Column:
    """The classes that occur in a name, as an array; a name counts for each of them."""
    return F.filter(F.array(*map(F.lit, classes)), lambda c: F.contains(name, c))


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where it is unset, one is made, but only if all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="rasterlake-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder and read back: later readings see the same rows, whichever executors are lost."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, *by: str) -> DataFrame:
    """Adds ``__part`` and ``__place``: the number of a partition of the rows sorted by ``by`` (nulls first), and the place in it.

    Partitions are ranges of about equal size, so a hot key is cut by the columns after it. The rows are written once to
    the checkpoint folder; places come from that writing.
    """
    out = written(df.orderBy(*by).withColumn("__id", F.monotonically_increasing_id()))
    return out.withColumn("__part", F.shiftright("__id", 33)).withColumn("__place", F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id")


def ranked(df: DataFrame, by: str, name: str = "rank") -> DataFrame:
    """Adds the row's place (from 0) in the order of ``by``, nulls first, by a distributed sort.

    Places come from positions in the sorted partitions and the sizes of those before; only a row for each
    partition meets in one task. Equal keys get places of their own.
    """
    rows = placed(df, by)
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    out = rows.join(F.broadcast(before), "__part")  # a row for each partition
    return out.withColumn(name, F.col("__before") + F.col("__place")).drop("__part", "__place", "__before")


def zip_by_rank(left: DataFrame, right: DataFrame, by: str) -> DataFrame:
    """Positional join of two lists, each sorted by ``by``, as far as the shorter goes; columns of the right get ``_r``."""
    r = ranked(right, by)
    return ranked(left, by).join(r.toDF(*[c if c == "rank" else f"{c}_r" for c in r.columns]), "rank")


def integrity(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with that side. A null key matches nothing and is on one side only; repeated keys come as often as they are."""
    only = lambda a, b, side: a.join(b, key, "left_anti").select(key, F.lit(side).alias("only_in"))
    return only(left.select(key), right.select(key), "left").union(only(right.select(key), left.select(key), "right"))


def same_list(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows by which two lists differ as multisets; none if they are equal."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).union(right.exceptAll(left).withColumn("side", F.lit("right")))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key. Null keys replace nothing; repeated rows stay as they are."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def pairing(left: DataFrame, right: DataFrame, key: str, size: list[str]) -> DataFrame:
    """Each key of two listings and what becomes of it, as ``outcome``: ``paired``, ``resized`` (sizes differ), ``no_prediction`` or ``no_mask``.

    ``left`` are the masks, which drive, ``right`` the predictions; both have the columns of ``size``. A null size is one that could not be read: the
    file counts as missing. Null keys pair with nothing.
    """
    known = lambda df: df.where(" AND ".join(f"{c} IS NOT NULL" for c in size)).select(key, F.struct(*size).alias("s"))
    both = known(left).withColumnRenamed("s", "l").join(known(right).withColumnRenamed("s", "r"), key, "full")
    outcome = F.when(F.col("r").isNull(), "no_prediction").when(F.col("l").isNull(), "no_mask").when(F.col("l") == F.col("r"), "paired").otherwise("resized")
    return both.select(key, outcome.alias("outcome"))


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds ``batch``: runs of ``size`` rows in ``order``; the last may be shorter."""
    return ranked(df, order).withColumn("batch", F.expr(f"rank div {size}"))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds ``place``, an order that a seed decides and every run and engine repeats."""
    return df.withColumn("place", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")))


def write_snapshot(df: DataFrame, root: str, iteration: int) -> str:
    """Replace the snapshot of an iteration, and give its path.

    The new files are published once they are complete: a job that dies leaves the former snapshot, and readers of it keep its files.
    """
    return catalogue.publish(df, root, f"iteration={iteration}")


def read_snapshot(spark: SparkSession, root: str, iteration: int, as_of: int | None = None) -> DataFrame:
    """The snapshot of an iteration, as published last or up to a version of the catalogue; an error if there is none."""
    return catalogue.load(spark, root, f"iteration={iteration}", as_of=as_of)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
