import hashlib
import struct
import zlib

import numpy as np

import corpus_pipeline
from rasterlake.llm import bpe, quality

SF = "/root/testdata/sf0.001"


def brute_scores(spark):
    """Scores without a DataFrame: the same features and fit on lists. The tables are smaller than the sample, so all rows are in it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    of = lambda rows: np.array([quality.text_features(d.text) for d in rows], dtype=np.float64)
    train = sorted((d for d in docs if not held(d.doc_id)), key=lambda d: d.doc_id)
    model = quality.fit(of([d for d in train if labels.get(d.doc_id) == 1]), of([d for d in train if d.doc_id not in labels]))
    return {d.doc_id: (held(d.doc_id), float(s)) for d, s in zip(docs, model.score(of(docs)), strict=True)}


def test_quality_query_and_stage_by_brute_force(spark):
    want = brute_scores(spark)
    got = quality.op7_quality(spark, SF).collect()
    assert {r.doc_id: (r.held_out, round(r.score, 9), r.predicted) for r in got} == {i: (h, round(s, 9), int(s >= 0.3)) for i, (h, s) in want.items()}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, SF).collect()
    assert sorted(r.doc_id for r in kept) == sorted(i for i, (_, s) in want.items() if s >= 0.3)


def test_encode_stage_by_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_tokenizer())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in corpus_pipeline.encode(spark, docs, SF).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert (bytes(r.ids), r.n_tokens, r.ids_sha256) == (raw, len(ids), hashlib.sha256(raw).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_one_row_of_a_group_stays_whatever_the_order(spark):
    """Rows that are made anew at each reading, in an order of their own, keep one row of each group all the same."""
    from pyspark.sql import functions as F

    text = "some words that are the same in many of the rows of this table"
    docs = spark.range(400).select((F.col("id") % 100).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit(text)).otherwise(F.concat(F.lit("words of row "), F.col("id").cast("string"), F.lit(" that no other row has at all"))).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).alias("n_chars"))
    docs = docs.orderBy(F.rand())
    out = corpus_pipeline.jaccard(spark, docs, SF).collect()
    assert len(out) == 201 and [r.doc_id for r in out if r.text == text] == [0]


def test_stages_take_very_long_texts(spark):
    long = " ".join(f"word{k % 20_011}" for k in range(150_000))
    docs = spark.createDataFrame([(1, long, "en", "s", 1, 5), (2, long + " more", "en", "s", 1, 5), (3, None, None, None, None, 5)], "doc_id long, text string, lang string, source string, n_chars long, n_hit int")
    assert sorted(r.doc_id for r in corpus_pipeline.jaccard(spark, docs, SF).collect()) == [1, 3]
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, SF)
        assert rows.count() <= 3 and (name == "encode" or rows.columns == docs.columns)
