"""Sinks: masks as bytes, reports as files and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mask_bytes(df: DataFrame, values: str = "p") -> DataFrame:
    """Probabilities as grey values 0 to 255 (half to even), in ``px``."""
    return df.withColumn("px", F.transform(values, lambda v: F.rint(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")))


def write_masks(df: DataFrame, path: str, values: str = "p") -> None:
    mask_bytes(df, values).select("img_id", "h", "w", "px").write.mode("overwrite").parquet(path)


def write_report(report: DataFrame, path: str, dataset: str = "dataset") -> None:
    """One CSV folder for each dataset; a report has a row for each group, so the files are small."""
    report.write.mode("overwrite").partitionBy(dataset).option("header", True).csv(path)


def write_report_texts(report: DataFrame, root: str, dataset: str = "dataset") -> None:
    """The text table of each dataset in ``<root>/<dataset>_eval.txt``, by Spark's own file system; a null dataset is ``null``."""
    spark = report.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    for name in sorted({str(r[0]) for r in report.select(F.coalesce(dataset, F.lit("null"))).distinct().collect()}):
        at = path(f"{root.rstrip('/')}/{name}_eval.txt")
        out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
        try:
            out.write(bytearray((report_text(report.where(F.coalesce(dataset, F.lit("null")) == name)) + "\n").encode()))
        finally:
            out.close()


def report_text(report: DataFrame) -> str:
    """The report as a table of text, in order of its first columns. It is collected: a report has one row for each dataset and method."""
    rows = [report.columns, *sorted([f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in report.collect())]
    width = [max(len(r[k]) for r in rows) for k in range(len(rows[0]))]
    return "\n".join("| " + " | ".join(c.ljust(n) for c, n in zip(r, width, strict=True)) + " |" for r in rows)
