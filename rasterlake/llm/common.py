"""What the corpus operators share: the shared folder, written tables and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_HELD: dict[str, Callable[[], object]] = {}


def holds(owner: str, release: Callable[[], object]) -> None:
    """Say how to let go of what ``owner`` keeps in a worker process from one task to the next."""
    _HELD[owner] = release


def begin_task(owner: str) -> None:
    """Called as a task of ``owner`` begins: its worker lets go of what other operators kept, so that caches of several do not add up."""
    for other, release in _HELD.items():
        if other != owner:
            release()
    pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Where it is unset, one is made, but only if all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="rasterlake-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The lineage ends there, and a lost executor costs no recomputation of what came before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a table that ``materialize`` wrote, once nothing lazy reads it any more."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if path.startswith(("file:", "hdfs:", "s3", "gs:", "abfs", "/", "viewfs:")) and shared_dir(spark).split("://")[-1] in path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def input_partitions(df: DataFrame) -> int:
    """Shuffle partitions that this session asks for; one place to read the setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Alternating large-star and small-star steps, each a join and an aggregation on the node, so the state
    is one row per edge and no group is gathered in one task. Nulls and self-edges are ignored; an empty
    input gives no rows. Each round is written to the shared folder, which also ends its lineage; rounds go on until
    one changes nothing (their number grows with the logarithm of the nodes).
    """

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.lit(0)).alias("s")).first()
        return r.n, r.s

    e = materialize(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    before = state(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        after_df = materialize(small)
        release(e)
        after = state(after_df)
        e = after_df
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
