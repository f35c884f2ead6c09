import itertools
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from rasterlake.llm import sharding

SF = "/root/testdata/sf0.001"


def test_op5_sql(spark, same_rows):
    same_rows(sharding.op5_hilbert(spark, SF), sharding.OP5_SQL, SF)


def files_to_read(folder, **want):
    """How many files a reader opens that looks at the ranges of columns first."""
    n = total = 0
    for path in Path(folder).glob("*.parquet"):
        meta = pq.ParquetFile(path).metadata
        if not meta.num_rows:
            continue
        total += 1
        groups = [meta.row_group(k) for k in range(meta.num_row_groups)]
        at = {meta.schema.column(k).name: k for k in range(meta.num_columns)}
        n += any(all(g.column(at[c]).statistics.min <= hi and g.column(at[c]).statistics.max >= lo for c, (lo, hi) in want.items()) for g in groups)
    return n, total


def test_files_are_skipped_by_several_columns(spark, tmp_path):
    rows = [(k, "x" * (3 + (k * 37) % 400), lang, source) for k, (lang, source, _) in enumerate(itertools.product(["de", "en", "fr", "it"], ["a", "b", "c", "d", "e"], range(100)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n", F.length("text")).repartition(5)
    sharding.write_clustered(docs, str(tmp_path / "near"), files=40)
    docs.repartition(40).write.parquet(str(tmp_path / "any"))
    back = spark.read.parquet(str(tmp_path / "near"))
    assert back.columns == docs.columns and back.exceptAll(docs).isEmpty() and back.count() == 2000
    for want in ({"source": ("b", "b"), "lang": ("fr", "fr")}, {"source": ("d", "d")}, {"lang": ("en", "en"), "n": (300, 403)}, {"doc_id": (500, 600), "source": ("a", "b")}):
        (near, total), (every, _) = files_to_read(tmp_path / "near", **want), files_to_read(tmp_path / "any", **want)
        assert every == 40 and total >= 30 and near <= 0.55 * total, want
    sharding.write_clustered(docs.limit(0), str(tmp_path / "near"))
    assert spark.read.parquet(str(tmp_path / "near")).count() == 0


def test_clashing_names_ties_and_long_texts(spark):
    rows = [(1, "a", "en", "s", 5), (1, "a", "en", "s", 6), (2, "é" * 300_000, None, "s", 7), (None, None, None, None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, shard int").withColumn("curve", F.lit("x")).withColumn("size", F.lit(-1))
    got = sharding.document_shards(docs, shards=3).collect()
    assert sorted((r.doc_id or 0, r.size) for r in got) == [(0, 1), (1, 2), (1, 2), (2, 600_001)] and {r.shard for r in got} == {0, 1, 2}
    plain = sharding.hilbert_shards(docs.select("doc_id", "shard", "curve"), [F.lit(1), F.lit(2)], ["doc_id"], 2).collect()
    assert sorted((r.shard, r.slot) for r in plain) == [(0, 0), (0, 1), (1, 0), (1, 1)] and len({r.curve for r in plain}) == 1
