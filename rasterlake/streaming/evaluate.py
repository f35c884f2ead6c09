"""Extension (the evaluation itself has no stream): scores over a stream of raster pairs, taken up step by step and finished at any time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rasterlake.operators import metrics
from rasterlake.sources import catalogue

IDS = ["img_id", "method", "dataset"]


def mae_stream(pairs: DataFrame) -> DataFrame:
    """Images are scored on their own, so their mean can be kept up in complete or update mode; state is one row a method."""
    return metrics.mae(metrics.prepare(pairs)).groupBy("method").agg(F.avg("mae").alias("mae"), F.count("*").alias("images"))


def accumulate(pairs: DataFrame, root: str, *by: str, ids: list[str] | None = None, event_time: str | None = None, delay: str = "1 day", **trigger: object) -> StreamingQuery:
    """Take up a stream of raster pairs; ``results`` gives the nine scores of what has been taken up.

    Pairs are scored where they arrive, and only the first of each of ``ids`` counts, also after a restart: Spark's state store holds the ids (for ever, or for ``delay`` of
    ``event_time`` if named). A batch adds one version to the catalogue at ``root``: 256 rows of sums for each group of ``by``. Batches are
    named by their number, so one that is repeated after a failure replaces itself, and one that dies in between leaves nothing. Start it again with the same ``root`` to go on.
    ``trigger`` is passed on (``availableNow=True``, ``processingTime="1 minute"``).
    """
    ids = IDS if ids is None else ids
    scored = metrics.scored(metrics.prepare(pairs), *dict.fromkeys([*ids, *by, *([event_time] if event_time else [])]))
    # Scores travel, pixels do not: an image of any size is 512 counts here.
    first = scored.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(ids) if event_time else scored.dropDuplicates(ids)

    def add(batch: DataFrame, number: int) -> None:
        catalogue.publish(metrics.partial_sums(batch, *by), root, f"batch={number}")

    writer = first.writeStream.foreachBatch(add).option("checkpointLocation", f"{root.rstrip('/')}/progress")
    return (writer.trigger(**trigger) if trigger else writer).start()


def results(spark: SparkSession, root: str, *by: str) -> DataFrame:
    """The nine scores of each group over all batches taken up so far; nothing taken up gives no rows."""
    return metrics.merged_report(catalogue.load_all(spark, root, "batch="), *by)


def compact(spark: SparkSession, root: str, *by: str) -> None:
    """Merge the sums of all batches but the newest, which may yet be repeated, into one version: the state stays as small as its groups however long the stream runs."""
    catalogue.merge(spark, root, "batch=", lambda parts: metrics.added(parts, *by))
