"""Importance resampling towards a target: documents are drawn by how much likelier the target makes their n-grams.

Everything is DataFrame expressions. A document's n-grams are never rows of their own when it is scored: higher-order functions make
the array of its buckets and add up entries of a literal array of gains. Only counts for each bucket and one narrow row a document move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterlake.functions.once import bound
from rasterlake.llm.common import materialize, table

#: The letters that are put into lower case, and what a word is after that. Java looks single characters up in a
#: table; the same class as a complement of ranges takes more than ten times as long.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = "[0123456789" + LOWER + r"\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    """The words of a whole text in order, A to Z in lower case; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), 0)


def bucket_array(found: Column, runs: int, buckets: int) -> Column:
    """The bucket of each run of 1 to ``runs`` consecutive words (joined by a blank), repeats included; no words give an empty array."""
    cell = lambda c: F.pmod(F.crc32(c.cast("binary")), F.lit(buckets)).cast("int")

    def of_length(w: Column, n: int) -> Column:
        if n == 1:
            return F.transform(w, cell)
        run = lambda _, i: cell(F.concat_ws(" ", F.slice(w, i + 1, n)))
        return F.slice(F.transform(w, run), 1, F.greatest(F.size(w) - (n - 1), F.lit(0)))

    return bound(found, lambda w: F.concat(*[of_length(w, n) for n in range(1, runs + 1)]))


def featurised(docs: DataFrame, text: str, runs: int, buckets: int, *keep: str) -> DataFrame:
    """``keep``, ``__words`` (their number) and ``__cells``, the bucket array, of each row; narrow."""
    split = docs.select(*keep, bound(words(F.col(text)), lambda w: F.struct(F.size(w).alias("n"), bucket_array(w, runs, buckets).alias("cells"))).alias("__f"))
    return split.select(*keep, F.col("__f.n").alias("__words"), F.col("__f.cells").alias("__cells"))


def bucket_counts(docs: DataFrame, text: str, runs: int, buckets: int) -> DataFrame:
    """``(bucket, n)``: how many features of all rows fall into each bucket; a task sends at most one row a bucket."""
    # Explode would add a filter on the size of the array, and work the array out once more for it.
    cells = featurised(docs, text, runs, buckets).select(F.explode_outer("__cells").alias("bucket"))
    return cells.groupBy("bucket").agg(F.count("bucket").alias("n")).where("bucket IS NOT NULL")


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """The gain of each bucket, in order: ``floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets))))`` from two tables of counts.

    The list has ``buckets`` entries however many rows were counted, so it can be part of a plan. A bucket that neither table has counts 0 in both.
    """
    both = (
        raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(target.select("bucket", F.lit(0).cast("long"), "n"))
        .groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    )
    every = both.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(both, "bucket", "left").fillna(0, ["s", "t"])
    totals = Window.partitionBy()
    ratio = F.expr("(CAST(t + 1 AS DOUBLE) * CAST(tt + bb AS DOUBLE)) / (CAST(s + 1 AS DOUBLE) * CAST(st + bb AS DOUBLE))")
    sized = every.withColumn("tt", F.sum("s").over(totals)).withColumn("st", F.sum("t").over(totals)).withColumn("bb", F.lit(buckets))
    rows = sized.select("bucket", F.floor(1000 * F.ln(ratio)).cast("int").alias("gain")).collect()
    return [g for _, g in sorted((r.bucket, r.gain) for r in rows)]


def weighted(docs: DataFrame, table_of_gains: list[int], text: str, runs: int, *keep: str) -> DataFrame:
    """``keep``, ``n_words``, ``n_features`` and ``weight`` (floored mean gain, 0 without features) of each row; narrow.

    The gains are one literal array: text that the optimizer turns into an array before anything runs.
    """
    literal = F.split(F.lit(",".join(map(str, table_of_gains))), ",").cast("array<int>")
    total = F.aggregate("__cells", F.lit(0).cast("long"), lambda a, b: a + F.element_at(literal, b + 1))
    cells = featurised(docs, text, runs, len(table_of_gains), *keep)
    mean = F.when(F.size("__cells") == 0, F.lit(0)).otherwise(F.floor(total / F.size("__cells")))
    return cells.select(*keep, F.col("__words").cast("long").alias("n_words"), F.size("__cells").cast("long").alias("n_features"), mean.cast("long").alias("weight"))


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths that key and seed decide: ``floor(-1000 ln(-ln((h + 0.5) / 2^32)))``; a null key counts as empty."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def draw(scored: DataFrame, key: str, percent: int, least_words: int) -> DataFrame:
    """Adds ``rank``: 1, 2, 3 ... down the scores among the ``percent`` % (rounded down) highest of rows with ``least_words`` words; else null.

    Ties go to the smaller key, then to rows with fewer features; nulls come last among equal scores, and equal rows come in any order. One range-partitioned sort of ``scored``,
    which should be narrow and written, as the sort reads it twice; only a row for each partition meets in one task.
    """
    able = F.col("n_words") >= least_words
    order = [F.col("__able").desc(), F.col("score").desc(), F.col(key).asc_nulls_last(), F.col("n_features"), F.col("__any")]
    marked = scored.withColumn("__able", able).withColumn("__any", F.monotonically_increasing_id())
    placed = materialize(marked.orderBy(*order).drop("__any").withColumn("__place", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__place", 33))
    parts = placed.groupBy("__part").agg(F.count("*").alias("n"), F.count_if("__able").alias("able"))
    whole = Window.partitionBy()
    before = parts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"), F.sum("able").over(whole).alias("__all"))
    ranked = placed.join(F.broadcast(before), "__part")  # a row for each partition
    rank = F.col("__before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    drawn = F.col("__able") & (rank <= F.expr(f"__all * {percent} div 100"))
    return ranked.withColumn("rank", F.when(drawn, rank)).drop("__able", "__place", "__part", "__before", "__all")


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", target_text: str = "text", runs: int = 2, buckets: int = 10_000, percent: int = 25, least_words: int = 20, seed: int = 7,
) -> DataFrame:
    """``key``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row of ``docs``, drawn towards the texts of ``target``.

    Whole texts count. A null or empty text has no features and weight 0. Repeated rows are rows of their own. An empty target leaves the gains
    to the corpus alone; empty ``docs`` give no rows. Other columns are not read, whatever their names.

    Texts are read twice, for counts and for scores, and nothing of them is written: the arrays of buckets would take about as much as the texts.
    """
    rows, goal = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text")), target.select(F.col(target_text).alias("__text"))
    table_of_gains = gains(bucket_counts(rows, "__text", runs, buckets), bucket_counts(goal, "__text", runs, buckets), buckets)
    narrow = weighted(rows, table_of_gains, "__text", runs, "__key")
    scored = materialize(narrow.withColumn("score", F.col("weight") + noise(F.col("__key"), seed)))
    return draw(scored, "__key", percent, least_words).select(F.col("__key").alias(key), "n_words", "n_features", "weight", "score", "rank")


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of all ``documents`` drawn towards ``benchmark``; see ``resample`` for nulls, ties, repeated rows and empty tables."""
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
OP11_SQL = rf"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
txt AS (SELECT row_number() OVER () AS r, doc_id, text, true AS own FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, false FROM benchmark),
w AS (SELECT r, doc_id, own, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM txt),
f AS (SELECT r, own, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w WHERE len(w) > 0),
b AS (SELECT f, {_CRC} % 10000 AS b FROM (SELECT DISTINCT f FROM f), tab),
n AS (SELECT r, own, b, count(*) AS n FROM f JOIN b USING (f) GROUP BY ALL),
c AS (SELECT b, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM n GROUP BY b),
z AS (SELECT coalesce(sum(n) FILTER (own), 0) AS ss, coalesce(sum(n) FILTER (NOT own), 0) AS tt FROM n),
g AS (SELECT b, floor(1000 * ln(((t + 1)::DOUBLE * (ss + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE))) AS g FROM c, z),
m AS (SELECT r, sum(n) AS k, floor(sum(n * g) / sum(n)) AS weight FROM n JOIN g USING (b) GROUP BY r),
sc AS (SELECT w.r, w.doc_id, len(w.w) AS words, coalesce(k, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
              coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(w.doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
       FROM w LEFT JOIN m USING (r) WHERE own),
rk AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features) AS k, count(*) FILTER (words >= 20) OVER () AS n FROM sc)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND k <= (25 * n) // 100 THEN k END AS rank FROM rk
"""
