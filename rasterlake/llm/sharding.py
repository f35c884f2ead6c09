"""Sharding along a Hilbert curve over several metadata dimensions; DataFrame expressions only.

Rows that are near in all dimensions stay near on the curve, so a run of it covers a small box of each
dimension and a reader can skip files by their ranges.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterlake.llm.common import materialize, table


@cache
def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """Digit and next state of a compact Hilbert curve, at ``state * 2**dims + cell``; a state is an entry corner and a direction."""
    cells = 1 << dims
    rotate = lambda x, k: ((x >> k % dims) | (x << (dims - k % dims))) & (cells - 1)
    gray = lambda x: x ^ (x >> 1)
    rank = {gray(i): i for i in range(cells)}
    ones = lambda x: ((x + 1) & ~x).bit_length() - 1  # noqa: E731  trailing ones
    entry = lambda w: 0 if w == 0 else gray(2 * ((w - 1) // 2))
    turn = lambda w: 0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % dims
    digit, after = [], []
    for state in range(cells * dims):
        e, d = divmod(state, dims)
        for cell in range(cells):
            w = rank[rotate(cell ^ e, d + 1)]
            digit.append(w)
            after.append((e ^ rotate(entry(w), -(d + 1))) * dims + (d + turn(w) + 1) % dims)
    return digit, after


def hilbert_index(columns: list[Column], bits: int) -> Column:
    """Position on the curve of a cell whose coordinates (integers below ``2**bits``) are ``columns``, as a long.

    A null coordinate gives a null position. Dimensions times bits must be at most 62.
    """
    dims = len(columns)
    if dims * bits > 62:
        raise ValueError("the index must fit into a long")
    digit, after = (F.array(*map(F.lit, t)) for t in curve_tables(dims))
    point = F.array(*[c.cast("int") for c in columns])

    def step(s: Column, level: Column) -> Column:
        cell = F.lit(0)
        for k in range(dims):
            cell = cell + F.shiftleft(F.call_function("shiftright", F.get(s["p"], F.lit(k)), level).bitwiseAND(1), k)
        at = s["state"] * (1 << dims) + cell
        return F.struct((s["index"] * (1 << dims) + F.get(digit, at)).cast("long").alias("index"), F.get(after, at).cast("int").alias("state"), s["p"].alias("p"))

    levels = F.array(*[F.lit(b) for b in range(bits - 1, -1, -1)])
    return F.aggregate(levels, F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"), point.alias("p")), step)["index"]


def category(c: Column, bits: int) -> Column:
    """A category's cell; equal categories share one, nulls have that of the empty string."""
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(1 << bits)).cast("int")


def hilbert_shards(rows: DataFrame, dims: list[Column], ties: list[str], shards: int, bits: int = 8) -> DataFrame:
    """Add ``curve``, ``shard`` and ``slot``: runs of the curve whose row counts differ by one at most.

    ``dims`` are integer cells below ``2**bits``, their nulls count as 0; rows of a cell are ordered by ``ties``, nulls first.
    Input columns with the names of the three outputs are replaced. Names that begin with two underscores are not allowed.
    ``shard`` is 0 to ``shards - 1`` and ``slot`` counts up from 0 in each shard. Repeated rows take a slot each;
    with fewer rows than shards, some shards stay empty; an empty table gives no rows.

    One range-partitioned sort of ``rows``, which should be narrow. Ranks are the row's place in its partition
    plus the size of the partitions before it; only the sizes of partitions pass through one task.
    """
    indexed = materialize(rows.withColumn("curve", hilbert_index([F.coalesce(d, F.lit(0)) for d in dims], bits)))
    ordered = indexed.orderBy("curve", *ties)
    placed = materialize(ordered.withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = Window.orderBy("__part")
    offsets = sizes.select("__part", (F.sum("n").over(before) - F.col("n")).alias("__offset"), F.sum("n").over(Window.partitionBy()).alias("__all"))
    ranked = placed.withColumn("__part", part).join(F.broadcast(offsets), "__part")  # a row for each partition
    rank = F.col("__offset") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = ranked.withColumn("__rank", rank).withColumn("shard", F.expr(f"((__rank + 1) * {shards} - 1) div __all").cast("int"))
    return ranked.withColumn("slot", F.col("__rank") - F.expr(f"(shard * __all) div {shards}")).drop("__part", "__place", "__offset", "__all", "__rank")


def document_cells(docs: DataFrame, bits: int) -> tuple[list[Column], Column, Column]:
    """Cells of ``docs`` by source, language, size and place of the id between the least and the greatest; size; checksum of the text.

    Size is the UTF-8 length of the text plus one; a null text has size 1 and checksum 0. A null id has a null cell.
    """
    body = F.coalesce(docs["text"], F.lit("")).cast("binary")
    size = (F.octet_length(body) + 1).cast("long")
    ids = docs.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    low, span = ids.low or 0, (ids.high or 0) - (ids.low or 0) + 1
    top = (1 << bits) - 1
    of_id = F.least(F.floor((docs["doc_id"] - low).cast("double") / float(span) * (top + 1)), F.lit(top)).cast("int")
    of_size = F.least(F.floor(F.log2(size) * (1 << bits) / 40), F.lit(top)).cast("int")
    return [category(docs["source"], bits), category(docs["lang"], bits), of_size, of_id], size, F.crc32(body)


def document_shards(docs: DataFrame, shards: int = 16, bits: int = 8) -> DataFrame:
    """Shard ``docs(doc_id, text, lang, source)`` by source, language, size and id; see ``document_cells`` for nulls.

    Gives ``doc_id``, ``size``, ``text_crc32``, ``curve``, ``shard`` and ``slot``; other columns are not read.
    """
    cells, size, crc = document_cells(docs, bits)
    narrow = docs.select(docs["doc_id"], size.alias("size"), crc.alias("text_crc32"), *[c.alias(f"c{k}") for k, c in enumerate(cells)])
    return hilbert_shards(narrow, [F.col(f"c{k}") for k in range(len(cells))], ["doc_id", "text_crc32", "size"], shards, bits).drop(*[f"c{k}" for k in range(len(cells))])


def write_clustered(docs: DataFrame, path: str, files: int = 16, bits: int = 8) -> None:
    """Write all columns of ``docs`` as Parquet files that are runs of the curve, for readers that skip files by the ranges of their columns.

    Rows move once, to ``files`` ranges of about equal numbers of rows (cut at sampled places, as Spark's range partitioning does;
    ``document_shards`` cuts exactly). What is at ``path`` is replaced; an empty table gives a folder without rows.
    """
    cells, size, crc = document_cells(docs, bits)
    order = ["__curve", "__id", "__crc", "__size"]
    placed = docs.select("*", hilbert_index([F.coalesce(c, F.lit(0)) for c in cells], bits).alias("__curve"), docs["doc_id"].alias("__id"), crc.alias("__crc"), size.alias("__size"))
    placed.repartitionByRange(files, *order).sortWithinPartitions(*order).drop(*order).write.mode("overwrite").parquet(path)


def op5_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 15 of all ``documents`` under the law ``rows``; see ``document_shards``. Repeated rows take a slot each; an empty table gives no rows."""
    out = document_shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def _sql() -> str:
    """The rows by the bitwise rules of checksum and curve, without tables: a rotation, a Gray code and its inverse at each level."""
    crc = lambda text: f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce({text}, ''))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
    rotate = lambda x, k: f"((({x}) >> (({k}) % 4)) | (({x}) << (4 - ({k}) % 4))) & 15"
    return f"""
    WITH RECURSIVE bits(i, k, c) AS (
      SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
    tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
    cat AS (SELECT v, {crc("v")} % 256 AS cell FROM (SELECT DISTINCT coalesce(source, '') AS v FROM documents UNION SELECT DISTINCT coalesce(lang, '') FROM documents), tab),
    ends AS (SELECT min(doc_id) AS low, max(doc_id) - min(doc_id) + 1 AS span FROM documents),
    doc AS (SELECT row_number() OVER () AS r, d.doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, {crc("text")} AS text_crc32, a.cell AS p0, b.cell AS p1
            FROM documents d JOIN cat a ON a.v = coalesce(d.source, '') JOIN cat b ON b.v = coalesce(d.lang, ''), tab),
    pt AS (SELECT r, doc_id, size, text_crc32, p0, p1, CAST(least(floor(ln(size) / ln(2) * 256 / 40), 255) AS BIGINT) AS p2,
                  coalesce(CAST(least(floor(CAST(doc_id - low AS DOUBLE) / CAST(span AS DOUBLE) * 256), 255) AS BIGINT), 0) AS p3 FROM doc, ends),
    walk(r, level, e, d, place) AS (
      SELECT r, 8, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM pt
      UNION ALL
      SELECT r, level - 1, xor(e, {rotate("CASE WHEN w = 0 THEN 0 ELSE xor(2 * ((w - 1) // 2), (w - 1) // 2) END", "3 - d")}),
             (d + 1 + CASE WHEN w = 0 OR o & 1 = 0 THEN 0 WHEN o & 3 = 1 THEN 1 WHEN o & 7 = 3 THEN 2 WHEN o & 15 = 7 THEN 3 ELSE 0 END) % 4, place * 16 + w
      FROM (SELECT *, CASE WHEN w % 2 = 0 THEN w - 1 ELSE w END AS o FROM (
        SELECT *, xor(xor(g, g >> 1), xor(g >> 2, g >> 3)) AS w FROM (
          SELECT walk.*, {rotate("xor(((p0 >> (level - 1)) & 1) + 2 * ((p1 >> (level - 1)) & 1) + 4 * ((p2 >> (level - 1)) & 1) + 8 * ((p3 >> (level - 1)) & 1), e)", "d + 1")} AS g
          FROM walk JOIN pt USING (r) WHERE level > 0)))),
    ranked AS (SELECT doc_id, size, text_crc32, place AS curve, row_number() OVER (ORDER BY place, doc_id NULLS FIRST, text_crc32, size) - 1 AS k, count(*) OVER () AS n FROM pt JOIN walk USING (r) WHERE level = 0)
    SELECT doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, k - (shard * n) // 16 AS slot, NULL::INTEGER AS grown_shard, curve
    FROM (SELECT *, ((k + 1) * 16 - 1) // n AS shard FROM ranked)
    """


OP5_SQL = _sql()
