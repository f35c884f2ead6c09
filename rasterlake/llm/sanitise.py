"""Sanitising of personal data: what patterns find, and the terms that tell who or what was there.

A protected entity is a value that a pattern finds (an address, a number). The information content of entity ``e`` is ``log2(N / n_e)`` bits in a
corpus of ``N`` texts; a term ``t`` near it discloses ``PMI(t; e) = log2(n_te N / (n_t n_e))`` of them. A term is revealing where at most ``left`` bits stay undisclosed
and at least ``gain`` bits are disclosed, and where ``contexts`` different texts around the entity bear witness. Revealing terms become a
prefix that many terms share, if that reveals no entity, and are removed otherwise.

Everything is DataFrame expressions. Texts are read in three narrow passes; what moves are windows around entities, counts and spans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterlake.functions.once import bound
from rasterlake.llm.common import materialize, table

KINDS = ["email", "ip", "card", "phone"]
_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_ADDRESS = rf"{_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++"
#: The patterns of the four kinds, possessive and started only where a run of their characters starts (or the match before ended), so that long runs take
#: linear time and no stack. They match what the plain forms match: no pattern could go on with less of a run, or start later in it.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_ADDRESS}",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_WORD = rf"[0123456789{_LETTERS}\x{{80}}-\x{{10FFFF}}]++"
_TERM = rf"^[{_LETTERS}\x{{80}}-\x{{10FFFF}}]{{2,}}+$"
#: Addresses (several without a gap are one token), numbers and words, so that no word lies in an address.
TOKEN = rf"(?<!{_LOCAL})(?:{_ADDRESS})++|{PATTERNS['phone']}|{PATTERNS['ip']}|{PATTERNS['card']}|{_WORD}"
_OCTET = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]?)"
#: Cells of the filter that keeps most words from moving.
CELLS = 1 << 20


def scan(values: Column, step: Callable[[Column, Column], Column], zero: Column) -> Column:
    """All running results of ``step`` over an array, by runs of about the root of its length: appending to one array would copy it each time."""

    def along(v: Column) -> Column:
        return F.aggregate(v, F.slice(F.array(zero), 1, 0), lambda a, x: F.concat(a, F.array(step(F.coalesce(F.get(a, F.size(a) - 1), zero), x))))

    def chunked(v: Column) -> Column:
        m = F.ceil(F.sqrt(F.size(v))).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / m).cast("int")), lambda c: along(F.slice(v, c * m + 1, m)))
        ends = lambda r: along(F.transform(r, lambda x: F.element_at(x, -1)))
        put = lambda r, e: F.flatten(F.transform(r, lambda x, c: F.transform(x, lambda y: F.when(c == 0, y).otherwise(step(F.get(e, c - 1), y)))))
        return bound(runs, lambda r: bound(ends(r), lambda e: put(r, e)))

    return F.when(F.size(values) == 0, F.slice(F.array(zero), 1, 0)).otherwise(bound(values, chunked))


def located(text: Column, pattern: str) -> Column:
    """Matches of ``pattern`` in ``text`` as an array of ``(start, end, value)`` in code points, from the matches and what lies between them."""

    def at(found: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        steps = F.transform(F.slice(gaps, 1, F.size(found)), lambda g, k: F.length(g) + F.coalesce(F.length(F.get(found, k - 1)), F.lit(0)))
        return F.zip_with(scan(steps, lambda a, x: a + x, F.lit(0)), found, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end"), m.alias("value")))

    return bound(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.when(F.size(m) > 0, at(m)).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>")))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check: from the right, every second digit counts double, less 9 above 9."""

    def add(total: Column, k: Column) -> Column:
        d = F.substr(digits, F.length(digits) - k, F.lit(1)).cast("int") * (k % 2 + 1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def holds_good(kind: str, m: Column) -> Column:
    """Whether a match of ``kind`` is one: parts of at most 255, 12 to 19 digits that pass Luhn, 9 to 15 digits."""
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return bound(_digits(m), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Spans ``(start, place, kind, end)`` of the four kinds in a whole text, by start and then kind; a null text has none."""
    text = F.coalesce(text, F.lit(""))

    def of(place: int, kind: str) -> Column:
        good = F.filter(located(text, PATTERNS[kind]), lambda m: holds_good(kind, m["value"]))
        return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    return F.array_sort(F.concat(*[of(place, kind) for place, kind in enumerate(KINDS)]))


def entity(token: Column) -> Column:
    """The protected value that a token is, with its kind; null for other tokens."""
    low = F.lower(token)  # ASCII
    number = bound(_digits(token), lambda d: F.when(token.startswith("+") & holds_good("phone", token), F.concat(F.lit("phone:"), d)).when(holds_good("card", token), F.concat(F.lit("card:"), d)))
    one = F.when(F.contains(token, F.lit("@")), F.concat(F.lit("email:"), low)).when(holds_good("ip", token), F.concat(F.lit("ip:"), token)).otherwise(number)
    return F.when(token.rlike(r"^\+?[0-9][0-9 ().-]+$|@"), one)


def term(token: Column) -> Column:
    """A token of letters only, two at least, with A to Z in lower case; null for other tokens."""
    return F.when(token.rlike(_TERM), F.translate(token, _LETTERS[:26], _LETTERS[26:]))


def general(t: Column, prefix: int) -> Column:
    """The prefix that stands for all terms with it; null for a term that is not longer."""
    return F.when(F.length(t) > prefix, F.concat(F.substring(t, 1, prefix), F.lit("*")))


def _known(a: Column) -> Column:
    return F.array_distinct(F.filter(a, lambda x: x.isNotNull()))


def witnesses(docs: DataFrame, text: str, reach: int, prefix: int) -> DataFrame:
    """``(row, entity, key, context)``, once each: a key that lies within ``reach`` tokens of an entity in a row, and the least of the surroundings it has there.

    Keys are terms, prefixes (with ``*``) and the empty string, which is near every entity. Exact copies are rows of their own but share their surroundings.
    Only what lies around entities moves.
    """
    tokens = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), 0)

    def around(t: Column, i: Column) -> Column:
        near = F.slice(t, F.greatest(i - reach, F.lit(0)) + 1, F.least(i, F.lit(reach)) + reach + 1)
        terms = lambda w: _known(F.transform(w, term))
        keys = lambda w: F.array_distinct(F.concat(F.array(F.lit("")), terms(w), _known(F.transform(terms(w), lambda x: general(x, prefix)))))
        return bound(near, lambda w: F.struct(entity(F.get(t, i)).alias("entity"), F.xxhash64(F.array_join(w, " ")).alias("context"), keys(w).alias("keys")))

    where = lambda t: F.filter(F.transform(t, lambda x, i: F.when(entity(x).isNotNull(), i)), lambda i: i.isNotNull())
    found = docs.select(bound(tokens, lambda t: F.transform(where(t), lambda i: around(t, i))).alias("found"), F.monotonically_increasing_id().alias("row"))
    rows = found.select("row", F.explode_outer("found").alias("f")).where("f IS NOT NULL").select("row", "f.entity", "f.context", F.explode_outer("f.keys").alias("key"))
    return rows.groupBy("row", "entity", "key").agg(F.min("context").alias("context"))


def filter_bits(keys: DataFrame) -> list[int]:
    """A filter of ``CELLS`` bits (as 64-bit numbers) that passes all of ``keys(key)``: of one size whatever their number."""
    cell = F.pmod(F.xxhash64("key"), F.lit(CELLS))
    words = keys.select(cell.alias("c")).groupBy(F.shiftright("c", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(c & 63 AS INT))")).alias("bits"))
    out = [0] * (CELLS // 64)
    for r in words.collect():
        out[r.w] = r.bits
    return out


def passes(bits: list[int]) -> Callable[[Column], Column]:
    literal = F.split(F.lit(",".join(map(str, bits))), ",").cast("array<long>")

    def test(key: Column) -> Column:
        return bound(F.pmod(F.xxhash64(key), F.lit(CELLS)), lambda c: F.bit_get(F.get(literal, F.shiftright(c, 6).cast("int")), c.cast("int").bitwiseAND(F.lit(63))) == 1)

    return test


def key_counts(docs: DataFrame, text: str, keys: DataFrame, prefix: int) -> DataFrame:
    """``(key, n)``: in how many rows each of ``keys(key)`` occurs. A filter of fixed size drops most words before anything moves; the join is exact."""
    test = passes(filter_bits(keys))
    tokens = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKEN), 0)
    both = lambda t: F.array_distinct(F.concat(t, _known(F.transform(t, lambda x: general(x, prefix)))))
    found = docs.select(bound(_known(F.transform(F.array_distinct(tokens), term)), lambda t: F.filter(both(t), test)).alias("keys"))
    return found.select(F.explode_outer("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n")).join(keys, "key", "left_semi")


def revealing_terms(docs: DataFrame, text: str = "text", reach: int = 10, prefix: int = 3, contexts: int = 3, left: float = 1.0, gain: float = 1.0) -> DataFrame:
    """``(term, instead)``: the terms that reveal an entity of the corpus, and the prefix put in their place (null: they are removed).

    Every row counts, copies too; null and empty texts hold nothing. A corpus without entities, or an empty one, has no revealing terms.
    """
    once = materialize(witnesses(docs, text, reach, prefix))
    # Counts are summed on the map side, so a hot entity or key does no harm. Only keys with enough witnesses are joined.
    seen = once.where("key <> ''").groupBy("entity", "key").agg(F.count("*").alias("n"), F.count_distinct("context").alias("contexts")).where(F.col("contexts") >= contexts)
    entities = once.where("key = ''").groupBy("entity").agg(F.count("*").alias("n_e"))
    near = once.where("key <> ''").select("row", "key").distinct().groupBy("key").agg(F.count("*").alias("near"))
    # A key is in at least as many rows as it is near entities in, so keys that many entities share are out before all rows are counted.
    able = F.col("n") * F.lit(2.0**left) >= F.col("near")
    likely = materialize(seen.join(near, "key").where(able).select("entity", "key", F.col("n").alias("n_te")))
    counted = key_counts(docs, text, likely.select("key").distinct(), prefix).select("key", F.col("n").alias("n_t"))
    total = docs.count()
    tight = F.col("n_te") * F.lit(2.0**left) >= F.col("n_t")
    told = F.col("n_te") * F.lit(float(total)) >= F.lit(2.0**gain) * F.col("n_t") * F.col("n_e")
    keys = likely.join(counted, "key").join(entities, "entity").where(tight & told).select("key").distinct()
    keys = materialize(keys)
    prefixes = keys.where(F.col("key").endswith("*")).select(F.col("key").alias("wide"), F.lit(True).alias("reveals"))
    terms = keys.where(~F.col("key").endswith("*")).select(F.col("key").alias("term"), general(F.col("key"), prefix).alias("wide"))
    return terms.join(prefixes, "wide", "left").select("term", F.when(F.col("reveals").isNull(), F.col("wide")).alias("instead"))


def sanitise(docs: DataFrame, text: str = "text", keep: list[str] | None = None, terms: DataFrame | None = None, **settings: float) -> DataFrame:
    """``keep`` (all columns unless given) and ``spans``, an array of ``(start, place, kind, end, instead)`` by start and kind, for every row.

    Kinds are those of the patterns, then ``term``; ends are exclusive, places are code points. ``terms`` are ``revealing_terms`` of the corpus, made from ``docs`` and
    ``settings`` unless given. Whole texts are searched; a null or empty text has no spans, and repeated rows have the same. Kept columns may have any name but ``spans``.
    """
    keep = docs.columns if keep is None else keep
    plain = docs.select(*[F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate(keep)], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    found = materialize((revealing_terms(docs, text, **settings) if terms is None else terms).select("term", "instead"))
    test = passes(filter_bits(found.select(F.col("term").alias("key"))))
    near = lambda c: F.exists(F.array_distinct(F.regexp_extract_all(c, F.lit(TOKEN), 0)), lambda t: F.coalesce(test(term(t)), F.lit(False)))
    hit = lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), term(m["value"]).alias("term"))
    hits = F.when(near(F.col("__text")), F.filter(F.transform(located(F.col("__text"), TOKEN), hit), lambda h: F.coalesce(test(h["term"]), F.lit(False))))
    names = [f"k{k}" for k in range(len(keep))]
    # Written once: numbers of rows must be the same for both readings.
    rows = materialize(plain.select(*names, base_spans(F.col("__text")).alias("base"), hits.alias("hits"), F.monotonically_increasing_id().alias("__row")))
    sure = rows.select("__row", F.explode_outer("hits").alias("h")).where("h IS NOT NULL").select("__row", "h.start", "h.end", "h.term").join(found, "term")
    more = sure.groupBy("__row").agg(F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("place"), F.lit("term").alias("kind"), "end", "instead")).alias("more"))
    base = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["place"].alias("place"), b["kind"].alias("kind"), b["end"].alias("end"), F.lit(None).cast("string").alias("instead")))
    spans = F.array_sort(F.when(F.col("more").isNull(), base).otherwise(F.concat(base, "more")))
    return rows.join(more, "__row", "left").select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], spans.alias("spans"))


def redact(found: DataFrame, text: str = "text", out: str = "sanitised") -> DataFrame:
    """Adds ``out``: ``text`` with each span of ``spans`` replaced by its general form or its kind in brackets; of spans that overlap, the first one's.

    A null text stays null. Takes time in proportion to the number of spans times the length of the text.
    """
    body, spans = F.col(text), F.col("spans")
    ends = scan(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x), F.lit(0))

    def pieces(e: Column) -> Column:
        def piece(s: Column, k: Column) -> Column:
            done = F.coalesce(F.get(e, k - 1), F.lit(0))
            label = F.coalesce(s["instead"], F.concat(F.lit("["), s["kind"], F.lit("]")))
            return F.when(s["start"] < done, F.lit("")).otherwise(F.concat(F.substr(body, done + 1, s["start"] - done), label))

        return F.concat(F.array_join(F.transform(spans, piece), ""), F.substr(body, F.coalesce(F.get(e, F.size(e) - 1), F.lit(0)) + 1))

    return found.withColumn(out, bound(ends, pieces))


def _line(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all ``documents``; see ``sanitise`` for nulls, repeated rows, long texts and empty tables."""
    found = sanitise(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("spans", lambda s: s["place"] < len(KINDS))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_line(base).cast("binary"), 256).alias("base_sha256"), _line(F.col("spans")).alias("spans"))


_PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
_LUHN = "list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 0 THEN {d}[i]::INT WHEN {d}[i]::INT > 4 THEN 2 * {d}[i]::INT - 9 ELSE 2 * {d}[i]::INT END)) % 10 = 0"
_GOOD = {
    "email": "true", "ip": "list_bool_and(list_transform(string_split(v, '.'), lambda x: length(ltrim(x, '0')) < 4 AND coalesce(try_cast(right(x, 4) AS INT), 0) <= 255))",
    "card": f"length(d) BETWEEN 12 AND 19 AND {_LUHN.format(d='d')}", "phone": "length(d) BETWEEN 9 AND 15",
}
_PLAIN_TOKEN = rf"(?:{_PLAIN['email']})+|{_PLAIN['phone']}|{_PLAIN['ip']}|{_PLAIN['card']}|[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+".replace("(\\.", "(?:\\.").replace("([\\x20-]?", "(?:[\\x20-]?")


def _places(pattern: str) -> str:
    """Matches ``v`` in the texts of ``doc``, with their place ``k`` and start: lengths of gaps and matches summed up."""
    return f"""SELECT r, k, v, CAST(list_sum(list_transform(g[:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:k - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM (
      SELECT r, m, g, unnest(m) AS v, unnest(range(1, len(m) + 1)) AS k FROM (SELECT r, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_split_to_array(text, '{pattern}') AS g FROM doc))"""


def _sql() -> str:
    base = " UNION ALL ".join(f"SELECT r, s, {place} AS place, '{kind}' AS kind, s + length(v) AS e FROM (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM ({_places(_PLAIN[kind])})) WHERE {_GOOD[kind]}" for place, kind in enumerate(KINDS))
    return f"""
    WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    base AS MATERIALIZED ({base}),
    tok AS MATERIALIZED (SELECT *, s + length(v) AS e, CASE WHEN regexp_full_match(v, '[A-Za-z\\x{{80}}-\\x{{10FFFF}}]{{2,}}') THEN translate(v, '{_LETTERS[:26]}', '{_LETTERS[26:]}') END AS term FROM ({_places(_PLAIN_TOKEN)})),
    ent AS (SELECT r, k, CASE WHEN v LIKE '%@%' THEN 'email:' || lower(v) WHEN regexp_full_match(v, '{_PLAIN["ip"]}') AND {_GOOD["ip"]} THEN 'ip:' || v
              WHEN v LIKE '+%' AND {_GOOD["phone"]} THEN 'phone:' || d WHEN {_GOOD["card"]} THEN 'card:' || d END AS entity
            FROM (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM tok WHERE regexp_matches(v, '^\\+?[0-9][0-9 ().-]+$|@'))),
    win AS (SELECT a.r, a.k, entity, string_agg(b.v, ' ' ORDER BY b.k) AS context, list(DISTINCT b.term) AS terms FROM (SELECT * FROM ent WHERE entity IS NOT NULL) a JOIN tok b ON a.r = b.r AND b.k BETWEEN a.k - 10 AND a.k + 10 GROUP BY a.r, a.k, entity),
    near AS (SELECT r, entity, context, unnest(list_distinct(list_concat([''], terms, list_transform(list_filter(terms, lambda t: length(t) > 3), lambda t: t[:3] || '*')))) AS key FROM win),
    onc AS (SELECT r, entity, key, min(md5(context)) AS context FROM near GROUP BY ALL),
    seen AS (SELECT entity, key, count(*) AS n, count(DISTINCT context) AS contexts FROM onc GROUP BY ALL),
    cnt AS (SELECT key, count(*) AS n FROM (SELECT DISTINCT r, unnest([term, CASE WHEN length(term) > 3 THEN term[:3] || '*' END]) AS key FROM tok WHERE term IS NOT NULL) WHERE key IS NOT NULL GROUP BY key),
    rev AS (SELECT DISTINCT a.key FROM seen a JOIN cnt USING (key) JOIN seen b ON b.entity = a.entity AND b.key = ''
            WHERE a.key <> '' AND a.contexts >= 3 AND 2 * a.n >= cnt.n AND a.n * (SELECT count(*) FROM doc) >= 2 * cnt.n * b.n),
    sp AS (SELECT * FROM base UNION ALL SELECT r, s, 4, 'term', e FROM tok WHERE term IN (SELECT key FROM rev)),
    agg AS (SELECT r, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in KINDS)}, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) FILTER (place < 4) AS b, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place) AS spans FROM sp GROUP BY r)
    SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in KINDS)}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM doc LEFT JOIN agg USING (r)
    """


OP12_SQL = _sql()
