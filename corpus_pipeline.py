"""From raw documents to token ids: quality, near-duplicates, benchmark contamination, encoding.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``docs``. Rows keep their
columns whatever their names; null and empty texts pass where a stage does not reject them; an empty table
passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm.bpe import default_tokenizer, encode_documents
from rasterlake.llm.common import materialize, table
from rasterlake.llm.decontaminate import decontaminate
from rasterlake.llm.jaccard import near_duplicates
from rasterlake.llm.quality import classify_quality


def _plain(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with names that clash with nothing, and the new name of each column."""
    names = {c: f"__d{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def _named(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(new).alias(old) for old, new in names.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on these documents and ``labels``, does not reject."""
    plain, names = _plain(docs)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias(names["doc_id"]), "quality")
    scored = classify_quality(plain, labels, text=names["text"], key=names["doc_id"])
    return _named(scored.where("predicted = 1"), names)


def jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest doc_id. Texts without words all stay."""
    plain, names = _plain(docs)
    # Numbered rows are written once: both readings below see the same numbers, whatever ``docs`` is and whichever executor is lost.
    rows = materialize(plain.withColumn("__row", F.monotonically_increasing_id()))
    found = near_duplicates(rows, text=names["text"], key=names["doc_id"], carry=["__row"], group="__group")
    order = F.struct(F.col(names["doc_id"]).isNull(), F.col(names["doc_id"]), F.col("__row"))
    first = found.where("__group is not null").groupBy("__group").agg(F.min_by("__row", order).alias("__row"))
    stay = materialize(first.select("__row").union(found.where("__group is null").select("__row")))
    # The same join at every size: whole rows move once, row numbers are hashed, nothing is broadcast or sorted.
    return _named(rows.join(stay.hint("shuffle_hash"), "__row", "left_semi"), names)


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which benchmark windows do not reach a twentieth of the words; the others go."""
    plain, names = _plain(docs)
    found = decontaminate(plain, table(spark, sf_dir, "benchmark"), text=names["text"])
    return _named(found.where("not contaminated"), names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of each document, their number, and digests of ids and decoded text."""
    return encode_documents(docs, default_tokenizer(), keep=["doc_id"], outputs=("ids", "ids_sha256", "decoded_sha256"))


STAGES = [("quality", quality), ("jaccard", jaccard), ("contamination", contamination), ("encode", encode)]
#: A trained classifier is the first stage, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
