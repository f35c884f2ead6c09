"""Repair of conversation structure: the cheapest edits that give turns an order, as a dynamic program that keeps ranks instead of strings.

Turns must read ``(s?(ua)+)?`` by the initials of their roles, which is a machine of four states. An edit of a row is a macro: a run of inserted turns, then
Keep, Rerole or Delete, written ``I*K``, ``I*R`` or ``I*D``. No macro is a prefix of another, so two audits of equally many rows compare like their macros in turn: a
layer needs only a rank for each state, the next ranks follow from (rank, macro), and audits are put together afterwards from parent pointers.

A conversation is cut where a global sort cuts it. Each piece is worked out for every pair of entry and exit state, and pieces are folded in order, so a conversation of
any length is spread over tasks; only its audit and its repaired turns, which are one row by nature, meet in one.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.functions.once import bound, settled
from rasterlake.llm.common import materialize, table

#: The machine: from nothing (0), after a system turn (1), a user turn (2), an assistant turn (3). It may stop at 0 and 3.
STATES = range(4)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: What an inserted or reroled turn is after each state, and the inserted turns that end a conversation.
NEXT = {0: "u", 1: "u", 2: "a", 3: "u"}
TAIL = {0: "", 1: "II", 2: "I", 3: ""}
NAMES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: More than two inserted turns in a row come back to a state that fewer reach.
MACROS = sorted("I" * k + op for k in range(3) for op in "KRD")


@lru_cache
def edges(symbol: str) -> list[list[tuple[int, int, int]]]:
    """For each state, the best way to each state that a row of ``symbol`` leads to: ``(to, cost, macro)``.

    Symbols: an initial ``s u a``, ``o`` for any other, in capitals if the text is cut off, and ``x`` for a row that must go.
    """
    out = []
    for start in STATES:
        best: dict[int, tuple[int, int]] = {}
        for number, macro in enumerate(MACROS):
            at, op = start, macro[-1]
            for _ in macro[:-1]:
                at = STEP[at, NEXT[at]]
            if op == "D":
                to, cost = at, DELETE
            elif symbol == "x":
                continue
            else:
                to, cost = STEP.get((at, symbol.lower() if op == "K" else NEXT[at])), (REROLE if op == "R" else 0) + (CUT_OFF if symbol.isupper() else 0)
            if to is not None:
                found = cost + INSERT * (len(macro) - 1), number
                best[to] = min(best.get(to, found), found)
        out.append([(to, *found) for to, found in best.items()])
    return out


def transfer(symbols: str) -> list[tuple[int, int, int, int, str]]:
    """``(entry, exit, cost, rank, audit)`` of the best edits of a run of rows for each pair of states that has any.

    Of equal costs, the audit that is least in ASCII counts; ranks order the audits of all pairs, and equal audits share one. One byte a row and pair is kept.
    """
    now = {(p, p): (0, 0) for p in STATES}
    parents = bytearray()
    for symbol in symbols:
        ways, after = edges(symbol), {}
        for (p, q), (cost, rank) in now.items():
            for to, more, macro in ways[q]:
                found = cost + more, rank, macro, q
                if (p, to) not in after or found < after[p, to]:
                    after[p, to] = found
        order = {key: k for k, key in enumerate(sorted({(rank, macro) for _, rank, macro, _ in after.values()}))}
        layer = bytearray(16)
        for (p, to), (_, _, macro, q) in after.items():
            layer[4 * p + to] = 16 * q + macro
        parents += layer
        now = {key: (cost, order[rank, macro]) for key, (cost, rank, macro, _) in after.items()}
    out = []
    for (p, q), (cost, rank) in sorted(now.items()):
        audit, at = [], q
        for k in range(len(symbols) - 1, -1, -1):
            at, macro = divmod(parents[16 * k + 4 * p + at], 16)
            audit.append(MACROS[macro])
        out.append((p, q, cost, rank, "".join(reversed(audit))))
    return out


def fold(pieces: list[list]) -> tuple[int, str]:
    """Cost and audit of a conversation from the transfers of its pieces in order, by the same ranks."""
    now, trail = {0: (0, 0)}, []
    for piece in pieces:
        after: dict[int, tuple] = {}
        for p, q, cost, rank, audit in piece:
            if p in now:
                found = now[p][0] + cost, (now[p][1], rank), p, audit
                if q not in after or found[:2] < after[q][:2]:
                    after[q] = found
        order = {key: k for k, key in enumerate(sorted({f[1] for f in after.values()}))}
        trail.append({q: f[2:] for q, f in after.items()})
        now = {q: (f[0], order[f[1]]) for q, f in after.items()}
    cost, _, tail, at = min((cost + INSERT * len(TAIL[q]), rank, TAIL[q], q) for q, (cost, rank) in now.items())
    out = [tail]
    for step in reversed(trail):
        at, audit = step[at]
        out.append(audit)
    return cost, "".join(reversed(out))


def layout(audit: str, initials: str) -> tuple[list[int], list[str]]:
    """The turns that an audit leaves: for each, the row it comes from (-1: inserted) and its new role (empty: its own)."""
    rows, roles, at = [], [], 0
    k = 0
    for op in audit:
        kept = op == "K"
        if op != "D":
            rows.append(-1 if op == "I" else k)
            roles.append("" if kept else NAMES[NEXT[at]])
            at = STEP[at, initials[k] if kept else NEXT[at]]
        k += op != "I"
    return rows, roles


_PIECES = "array<struct<entry:int,exit:int,cost:long,rank:int,audit:string>>"


def _transfer(symbols: pd.Series) -> pd.Series:
    known: dict[str, list] = {}  # of this batch: short conversations look alike
    fields = ("entry", "exit", "cost", "rank", "audit")
    return symbols.map(lambda s: known.setdefault(s, [dict(zip(fields, t, strict=True)) for t in transfer(s)]) if s not in known else known[s])


def _fold(transfers: pd.Series) -> pd.DataFrame:
    """Transfers of all pieces of a conversation in one array, with the number of the piece: arrays of arrays of different lengths do not become pandas values."""
    out = []
    for conversation in transfers:
        pieces = groupby(conversation, key=lambda t: t["piece"])
        out.append(fold([[(t["entry"], t["exit"], t["cost"], t["rank"], t["audit"]) for t in piece] for _, piece in pieces]))
    return pd.DataFrame(out, columns=["cost", "audit"])


def _layout(audit: pd.Series, initials: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([layout(*x) for x in zip(audit, initials, strict=True)], columns=["rows", "roles"])


#: Fixed value: what counts as visible.
VISIBLE = r"[^\x20\x09-\x0D]"


def diagnosed(rows: DataFrame) -> DataFrame:
    """Narrow rows in order: ``conv, turn, initial, symbol, blank, duplicate, truncated, part, id`` of ``rows(conv, turn, role, digest, blank, open)``.

    Order is by turn (nulls first), role and digest of the text, the sort is over all rows. The first fault of a row counts. Which row of equal ones came first is found by
    a minimum for each text, so copies in a hot conversation do no harm.
    """
    salted = rows.withColumn("__any", F.monotonically_increasing_id())
    placed = materialize(salted.orderBy("conv", "turn", "role", "digest", "__any").drop("__any").withColumn("id", F.monotonically_increasing_id()))
    first = placed.groupBy("conv", "role", "digest").agg(F.min("id").alias("id")).select("id", F.lit(True).alias("first"))
    told = placed.join(first, "id", "left")
    duplicate = ~F.col("blank") & F.col("first").isNull()
    truncated = ~F.col("blank") & ~duplicate & F.col("open")
    letter = F.substring("role", 1, 1)
    initial = F.when(letter.isin("s", "u", "a"), letter).otherwise("o")
    symbol = F.when(F.col("blank") | duplicate, "x").when(truncated, F.upper(initial)).otherwise(initial)
    return told.select("conv", "turn", initial.alias("initial"), symbol.alias("symbol"), "blank", duplicate.alias("duplicate"), truncated.alias("truncated"), F.shiftright("id", 33).alias("part"), "id")


def audits(told: DataFrame) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated, illegal, cost, audit, initials`` of each conversation in ``diagnosed`` rows."""
    listed = F.array_sort(F.collect_list(F.struct("id", "initial", "symbol", "turn")))
    counts = [F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")]
    pieces = told.groupBy("conv", "part").agg(listed.alias("l"), F.min("turn").alias("low"), F.max("turn").alias("high"), *counts)
    text = lambda c: F.array_join(F.transform("l", lambda x: x[c]), "")
    turns = F.size(F.array_distinct(F.filter(F.transform("l", lambda x: x["turn"]), lambda t: t.isNotNull())))
    pieces = pieces.select("conv", "part", text("symbol").alias("symbols"), text("initial").alias("initials"), "low", "high", turns.alias("turns"), "blank", "duplicate", "truncated")
    pieces = pieces.withColumn("t", F.pandas_udf(_transfer, _PIECES)("symbols")).drop("symbols")
    whole = pieces.groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("part", "initials", "t"))).alias("p"), F.array_sort(F.collect_list(F.struct("part", "low", "high", "turns"))).alias("n"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
    )
    known = F.filter("n", lambda x: x["turns"] > 0)
    shared = lambda n: F.size(F.filter(F.transform(n, lambda x, i: (i > 0) & (x["low"] == F.get(n, i - 1)["high"])), lambda b: b))
    # A turn that two pieces share counts once.
    distinct = bound(known, lambda n: F.aggregate(n, F.lit(0), lambda a, x: a + x["turns"]) - shared(n))
    span = F.array_max(F.transform("n", lambda x: x["high"])) - F.array_min(F.transform("n", lambda x: x["low"])) + 1
    numbered = lambda t, i: F.struct(i.alias("piece"), *[t[c].alias(c) for c in ("entry", "exit", "cost", "rank", "audit")])
    flat = F.flatten(F.transform("p", lambda x, i: F.transform(x["t"], lambda t: numbered(t, i))))
    # Arguments of a Python function with lambdas of their own are worked out in a step before it.
    whole = settled(whole.withColumn("flat", flat))
    out = whole.select(
        "conv", F.coalesce(span - distinct, F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated",
        F.array_join(F.transform("p", lambda x: x["initials"]), "").alias("initials"), F.pandas_udf(_fold, "cost long, audit string")("flat").alias("f"),
    )
    legal = F.length(F.regexp_replace("initials", "(?=su|ua|au).", "")) - F.length("initials")  # less than 0: a legal pair starts at each letter taken away
    illegal = F.greatest(F.length("initials") - 1, F.lit(0)) + legal
    return out.select("conv", "gaps", "blank", "duplicate", "truncated", illegal.cast("long").alias("illegal"), "f.cost", "f.audit", "initials")


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: its faults, ``cost`` and ``audit`` of the cheapest edits, and ``repaired``, an array of ``(role, text)``.

    A null role or text counts as one blank; null turns come first and are not gaps; a null conversation is one like any other. Rows with equal turns are ordered by role,
    then by the SHA-256 of their text, and equal rows are duplicates. A conversation of faulty rows alone has an audit of deletions and no turns left. An empty table gives no rows;
    other columns are not read. Texts move once, to their conversation.
    """
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    blank = ~F.col("text").rlike(VISIBLE)
    open_ = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*+\z")
    found = audits(diagnosed(rows.select("conv", "turn", "role", "digest", blank.alias("blank"), open_.alias("open"))))
    whole = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "digest", "text"))).alias("t"))
    both = found.withColumn("w", F.pandas_udf(_layout, "rows array<int>, roles array<string>")("audit", "initials")).join(whole.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")))
    turn_of = lambda i, k: F.get("t", i)
    made = F.zip_with("w.rows", "w.roles", lambda i, r: F.struct(F.when(r == "", turn_of(i, 0)["role"]).otherwise(r).alias("role"), F.when(i < 0, F.lit("")).otherwise(turn_of(i, 0)["text"]).alias("text")))
    return both.select(F.col("conv").alias(conv), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", made.alias("repaired"))


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` with faults by a checksum of conversation and turn: dropped, emptied, unpunctuated, repeated or reroled rows."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.pmod(F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")), F.lit(20))
    text = F.when(way == 1, "").when(way == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    copies = F.array_repeat(F.lit(1), F.when(way == 0, 0).when(way == 3, 2).otherwise(1).cast("int"))
    rows = conversations.select("conv_id", "turn", F.when(way == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), F.explode_outer(copies).alias("n"))
    return rows.where("n IS NOT NULL").drop("n")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``conversations``, damaged and repaired; one of which nothing is left has zeros, an empty audit and the digest of nothing. See ``repair`` for nulls, ties and repeated rows."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = repair(damaged(rows)).withColumnRenamed("conv_id", "c").withColumn("has", F.lit(True))
    every = rows.select("conv_id").distinct()
    out = every.join(fixed, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    flat = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce(flat, F.lit("")).cast("binary"), 256).alias("repaired_sha256"))


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
OP13_SQL = rf"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
src AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS way
        FROM (SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS f FROM conversations), tab),
nam AS (SELECT DISTINCT dense_rank() OVER (ORDER BY conv_id) AS conv, conv_id FROM conversations),
dam AS (SELECT conv, turn, CASE way WHEN 4 THEN 'user' ELSE role END AS role, CASE way WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM src, range(2) c(n) WHERE way <> 0 AND (n = 0 OR way = 3)),
num AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, regexp_extract(role, '^[sua]') AS ini FROM dam),
flt AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'duplicate'
               WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
               coalesce(lag(ini) OVER (PARTITION BY conv ORDER BY i) || ini NOT IN ('su', 'ua', 'au'), false) AS illegal FROM num),
stp(q, c, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(q, k, m) AS (VALUES (0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (0, 1, 2), (1, 1, 2), (2, 1, 3), (3, 1, 2), (0, 2, 3), (1, 2, 3), (2, 2, 2), (3, 2, 3)),
edt AS (SELECT ins.q, k, m AS q2, 2 * k + 3 AS cost, repeat('I', k) || 'D' AS macro, NULL AS keep, true AS del FROM ins
        UNION ALL SELECT ins.q, k, q2, 2 * k, repeat('I', k) || 'K', c, false FROM ins JOIN stp ON stp.q = m
        UNION ALL SELECT ins.q, k, q2, 2 * k + 2, repeat('I', k) || 'R', NULL, false FROM ins JOIN stp ON stp.q = m WHERE c <> 's'),
st(conv, i, q, cost, audit) AS (
  SELECT conv, 0::BIGINT, 0, 0::BIGINT, '' FROM nam
  UNION ALL
  SELECT conv, i, q2, cost, audit FROM (
    SELECT st.conv, flt.i, edt.q2, st.cost + edt.cost + CASE WHEN fault = 'truncated' AND NOT del THEN 1 ELSE 0 END AS cost, st.audit || macro AS audit,
           row_number() OVER (PARTITION BY st.conv, edt.q2 ORDER BY st.cost + edt.cost + CASE WHEN fault = 'truncated' AND NOT del THEN 1 ELSE 0 END, st.audit || macro) AS best
    FROM st JOIN flt ON flt.conv = st.conv AND flt.i = st.i + 1 JOIN edt ON edt.q = st.q AND (del OR fault NOT IN ('blank', 'duplicate')) AND (keep IS NULL OR keep = ini)) WHERE best = 1),
fin AS (SELECT conv, min({{'cost': cost + e, 'audit': audit || tail}}) AS b
        FROM st JOIN (SELECT conv, max(i) AS i FROM st GROUP BY conv) USING (conv, i) JOIN (VALUES (0, 0, ''), (1, 4, 'II'), (2, 2, 'I'), (3, 0, '')) t(q, e, tail) USING (q) GROUP BY conv),
chr AS (SELECT conv, p, b.audit[p] AS op, length(replace(b.audit[:p], 'I', '')) AS i, length(replace(b.audit[:p], 'D', '')) AS j FROM (SELECT *, unnest(range(1, length(b.audit) + 1)) AS p FROM fin)),
lay AS (SELECT chr.*, role, text, ini, max(CASE WHEN op = 'K' AND j = 1 AND ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY chr.conv) AS sys FROM chr LEFT JOIN flt ON flt.conv = chr.conv AND flt.i = chr.i AND op <> 'I'),
rep AS (SELECT conv, string_agg(CASE WHEN op = 'K' THEN role WHEN (j - 1 - sys) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS body FROM lay WHERE op <> 'D' GROUP BY conv),
cnt AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, {", ".join(f"count(*) FILTER (fault = '{c}') AS {c}" for c in ("blank", "duplicate", "truncated"))}, count(*) FILTER (illegal) AS illegal FROM flt GROUP BY conv)
SELECT conv_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))}, b.cost AS cost, b.audit AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM nam JOIN fin USING (conv) LEFT JOIN cnt USING (conv) LEFT JOIN rep USING (conv)
"""
