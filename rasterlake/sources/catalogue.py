"""Named versions of tables in a folder: written first, then published by one atomic rename.

A version is data in a folder of its own, never changed, and a record in ``versions/`` that names it. What is written but not recorded does not exist for readers, and
readers of an older version keep their files until ``retain`` removes it. All goes through Hadoop's file systems, so any store that renames files atomically will do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "version long, name string, path string, removed boolean, notes map<string,string>"


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, root: str) -> list[int]:
    log, fs = _path(spark, f"{root}/versions")
    if not fs.exists(log):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(log)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def record(spark: SparkSession, root: str, name: str, path: str | None = None, **notes: object) -> int:
    """Publish ``path`` (relative to ``root``; None: ``name`` is removed) as the newest version of ``name``, and give its number.

    The record is written aside and renamed to the next free number, which fails if another writer was first; then the number after it is tried.
    """
    root = root.rstrip("/")
    text = {"name": name, "path": path, "removed": path is None, "notes": {k: str(v) for k, v in notes.items()}}
    jvm = spark._jvm
    keep = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
    how = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    how[0] = keep
    while True:
        version = max(_versions(spark, root), default=0) + 1
        aside, fs = _path(spark, f"{root}/versions/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps({"version": version, **text}).encode()))
        out.close()
        final, _ = _path(spark, f"{root}/versions/{version:020d}.json")
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(aside, final, how)
            return version
        except Exception as e:  # noqa: BLE001
            fs.delete(aside, False)
            if not _taken(e):
                raise


def _taken(e: Exception) -> bool:
    cause = e.java_exception.toString() if hasattr(e, "java_exception") else str(e) if isinstance(e, PySparkException) else ""
    return "FileAlreadyExistsException" in cause


def publish(df: DataFrame, root: str, name: str, **notes: object) -> str:
    """Write ``df`` as a new version of ``name`` and publish it; gives the folder. A job that dies before the rename leaves the former version in place."""
    root = root.rstrip("/")
    path = f"data/{uuid.uuid4().hex}/{name}"
    df.write.parquet(f"{root}/{path}")
    record(df.sparkSession, root, name, path, **notes)
    return f"{root}/{path}"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """All records as a table; an absent or empty catalogue has none."""
    if not _versions(spark, root.rstrip("/")):
        return spark.createDataFrame([], RECORD)
    return spark.read.schema(RECORD).json(f"{root.rstrip('/')}/versions")


def current(records: DataFrame) -> DataFrame:
    """The newest version of each name that is not removed, by itself or by a version that ``replaces`` it."""
    fields = ["version", "path", "removed", "notes"]
    swept = records.select("version", F.explode_outer(F.from_json(F.col("notes")["replaces"], "array<string>")).alias("name")).where("name IS NOT NULL")
    gone = swept.select("version", "name", F.lit(None).cast("string").alias("path"), F.lit(True).alias("removed"), F.lit(None).cast("map<string,string>").alias("notes"))
    newest = records.select("name", *fields).unionByName(gone).groupBy("name").agg(F.max_by(F.struct(*fields), "version").alias("r"))
    return newest.where("NOT r.removed").select("name", "r.version", "r.path", "r.notes")


def resolve(spark: SparkSession, root: str, candidates: Iterable[str], as_of: int | None = None) -> str:
    """The folder of the first of ``candidates`` that is published (up to version ``as_of``); an error if none is."""
    records = listing(spark, root)
    if as_of is not None:
        records = records.where(F.col("version") <= as_of)
    names = list(candidates)
    ranked = spark.createDataFrame(list(enumerate(names)), "rank int, name string")
    best = ranked.join(current(records), "name").orderBy("rank").select("path").first()  # as many rows as candidates
    if best is None:
        raise FileNotFoundError(f"none of {', '.join(names)} is published in {root}")
    return f"{root.rstrip('/')}/{best.path}"


def load(spark: SparkSession, root: str, *candidates: str, as_of: int | None = None) -> DataFrame:
    """The table that ``resolve`` finds."""
    return spark.read.parquet(resolve(spark, root, candidates, as_of))


def load_all(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    """The union of the newest versions of all names with ``prefix``; an error if there is none."""
    paths = [r.path for r in current(listing(spark, root)).where(F.col("name").startswith(prefix)).select("path").collect()]  # a row for each name
    if not paths:
        raise FileNotFoundError(f"nothing with {prefix} is published in {root}")
    return spark.read.parquet(*[f"{root.rstrip('/')}/{p}" for p in paths])


def merge(spark: SparkSession, root: str, prefix: str, together: Callable[[DataFrame], DataFrame]) -> None:
    """Put all names with ``prefix`` but the newest into one of them by ``together``; the others are emptied by the same record, so no reader sees a row twice or not at all."""
    rows = sorted(current(listing(spark, root)).where(F.col("name").startswith(prefix)).select("name", "version", "path", "notes").collect(), key=lambda r: r.version)[:-1]
    if len(rows) < 2:
        return
    whole = together(spark.read.parquet(*[f"{root.rstrip('/')}/{r.path}" for r in rows]))
    publish(whole, root, rows[-1].name, replaces=json.dumps([r.name for r in rows[:-1]]))


def retain(spark: SparkSession, root: str, last: int, always: Iterable[str] = ()) -> list[str]:
    """Keep the ``last`` newest names and those of ``always``, and of each the newest version; remove the rest and give the names removed.

    Records of removal come first, so no reader starts on files that are about to go; older versions and files without a record, left by writers that died, go as well.
    Not for use beside a writer: what it has not published yet looks like that.
    """
    root = root.rstrip("/")
    rows = current(listing(spark, root)).select("name", "version", "path").collect()  # a row for each name
    rows.sort(key=lambda r: -r.version)
    keep = {r.name for r in [*[r for r in rows if r.name not in set(always)][:last], *[r for r in rows if r.name in set(always)]]}
    gone = [r.name for r in rows if r.name not in keep]
    for name in gone:
        record(spark, root, name)
    alive = {r.path.split("/")[1] for r in rows if r.name in keep}
    data, fs = _path(spark, f"{root}/data")
    if fs.exists(data):
        for s in fs.listStatus(data):
            if s.getPath().getName() not in alive:
                fs.delete(s.getPath(), True)
    return gone


def due(epochs: DataFrame, run: str, epoch: str, value: str, every: int, all_after: int | None = None) -> DataFrame:
    """``(run, name, epoch)``: what training saves of each run. ``epoch`` counts from 0 and names count from 1.

    ``epoch_<n>`` at every ``every`` epochs, and at each one after ``all_after`` if given; ``best`` is the last epoch whose ``value`` is strictly below all before it and the first
    (which is never saved as best itself). Null values improve nothing; of repeated epochs all count.
    """
    number = F.col(epoch) + 1
    regular = (number % every == 0) | (F.lit(False) if all_after is None else number > all_after)
    saved = epochs.where(regular).select(run, F.concat(F.lit("epoch_"), number.cast("string")).alias("name"), epoch).distinct()
    before = F.min(value).over(Window.partitionBy(run).orderBy(epoch).rangeBetween(Window.unboundedPreceding, -1))
    better = epochs.withColumn("__before", before).where(F.col(value) < F.col("__before"))
    return saved.unionByName(better.groupBy(run).agg(F.max(epoch).alias(epoch)).select(run, F.lit("best").alias("name"), epoch))


def first_available(wanted: DataFrame, have: DataFrame, key: str, names: list[str]) -> DataFrame:
    """``(key, name)`` for every key of ``wanted``: the first of ``names`` that ``have(key, name)`` holds for it; reading a key that has none is an error."""
    ranked = F.array(*map(F.lit, names))
    found = have.groupBy(key).agg(F.collect_set("name").alias("__have"))  # a key has a handful of names
    chosen = F.get(F.filter(ranked, lambda n: F.array_contains("__have", n)), F.lit(0))
    error = F.raise_error(F.concat(F.lit(f"none of {', '.join(names)} is saved for "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return wanted.select(key).distinct().join(found, key, "left").select(key, F.coalesce(chosen, error).alias("name"))
