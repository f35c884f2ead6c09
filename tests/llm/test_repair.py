import hashlib
import itertools
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterlake.llm import repair

SF = "/root/testdata/sf0.001"
ALPHABET = "suaoSUAOx"


def brute(symbols):
    """Cost and audit by all edits with at most two inserted turns in a gap."""
    best = None
    for gaps in itertools.product(("", "I", "II"), repeat=len(symbols) + 1):
        for ops in itertools.product("KRD", repeat=len(symbols)):
            if any(s == "x" and o != "D" for s, o in zip(symbols, ops, strict=True)):
                continue
            audit = "".join(g + o for g, o in zip(gaps, ops, strict=False)) + gaps[-1]
            cost = sum({"K": 0, "R": 2, "D": 3}[o] + (o != "D" and s.isupper()) for s, o in zip(symbols, ops, strict=True)) + 2 * audit.count("I")
            if best and (cost, audit) >= best:
                continue
            rows = iter(symbols.lower())
            turns = [{"I": "?", "R": "?", "K": r}[o] for o in audit for r in ["" if o == "I" else next(rows)] if o != "D"]
            if any(all(t in ("?", w) and not (w == "s" and t == "?") for t, w in zip(turns, want, strict=True)) for want in ("ua" * (len(turns) // 2), "s" + "ua" * (len(turns) // 2)) if len(want) == len(turns) and want != "s"):
                best = cost, audit
    return best


def whole(symbols):
    return repair.fold([repair.transfer(symbols)])


def test_op13_sql(spark, same_rows):
    same_rows(repair.op13_repair(spark, SF), repair.OP13_SQL, SF)


def test_against_all_edits():
    rng = random.Random(2)
    cases = ["", *ALPHABET, *map("".join, itertools.product(ALPHABET, repeat=2)), *("".join(rng.choices(ALPHABET, k=3)) for _ in range(60)), *("".join(rng.choices(ALPHABET, k=4)) for _ in range(8))]
    for symbols in cases:
        assert whole(symbols) == brute(symbols), symbols


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(ALPHABET, max_size=9), min_size=1, max_size=6))
def test_pieces_fold_to_the_whole(pieces):
    assert repair.fold([repair.transfer(p) for p in pieces]) == whole("".join(pieces))


def test_macros_are_prefix_free_and_ordered():
    assert not any(a != b and b.startswith(a) for a in repair.MACROS for b in repair.MACROS)
    assert sorted(repair.MACROS) == repair.MACROS


def expected(rows):
    """One conversation by a plain loop over its rows in order."""
    seen, symbols, initials, count = set(), "", "", {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            count[fault] += 1
        first = role[:1] if role[:1] in ("s", "u", "a") else "o"
        initials += first
        symbols += "x" if fault in ("blank", "duplicate") else first.upper() if fault else first
    cost, audit = whole(symbols)
    at, out = iter(rows), []
    for op in audit:
        row = None if op == "I" else next(at)
        if op != "D":
            out.append(["" if op != "K" else row[1], "" if op == "I" else row[2]])
    lead = bool(out) and out[0][0][:1] == "s"
    out = [(role or ("user", "assistant")[(k - lead) % 2], text) for k, (role, text) in enumerate(out)]
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    return (gaps, *count.values(), illegal, cost, audit, out)


def test_conversations_and_a_hot_one(spark):
    rng = random.Random(9)
    texts = ["Yes.", "no", " \t", "", None, "Wait! ", "a.\n\n", "Ünï?", "x" * 3000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "u", "Assistant"]
    rows = [(rng.randint(0, 40), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(500)]
    rows += [(99, k // 2, "user" if k % 2 else "assistant", rng.choice([f"t{k}.", "Same.", f"t{k}"])) for k in range(3000)]  # most rows
    rows += [(None, 5, "user", "Hi."), (None, None, "assistant", "Hi.")] + [(77, None, "user", "Copy.")] * 500
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, symbol int").repartition(7)
    rows += [(98, 0, "assistant" if k % 2 else "user", "Go on.") for k in range(2)] + [(98, 9, "tool", "")] * 2  # few kinds of rows: transfers of its pieces differ in number
    df = df.unionByName(spark.createDataFrame([(*r, "x", 1) for r in rows[-4:]], df.schema))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small as they are, pieces stay apart
    try:
        got = {r.conv_id: r for r in repair.repair(df).collect()}
        narrow = df.select(F.col("conv_id").alias("conv"), "turn", F.lit("user").alias("role"), F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("digest"), F.lit(False).alias("blank"), F.lit(False).alias("open"))
        spread = {r.conv: r.n for r in repair.diagnosed(narrow).groupBy("conv").agg(F.count_distinct("part").alias("n")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spread[99] > 2 and max(spread.values()) == spread[99]
    ordered = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        ordered.setdefault(conv, []).append((turn, role, text))
    assert set(got) == set(ordered)
    for conv, own in ordered.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        r = got[conv]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, [tuple(t) for t in r.repaired]) == expected(own), conv


def test_pieces_with_different_numbers_of_ways(spark):
    """A piece with system turns has more ways through it than others."""
    df = spark.createDataFrame([(1, k, "system" if k < 40 else "user" if k % 2 else "assistant", f"Turn {k}.") for k in range(400)], "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        (row,) = repair.repair(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (row.cost, row.audit) == whole("s" * 40 + "au" * 180) and len(repair.transfer("s" * 10)) != len(repair.transfer("au" * 5))


def test_damage(spark):
    rows = [(c, t, r, x) for c, t, r, x in itertools.product([1, None], [*range(40), None], ["user", None], ["A. b!c?", None])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, repair.damaged(df).collect()), key=repr)
    import zlib

    want = []
    for c, t, r, x in rows:
        way = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        x = "" if way == 1 else re.sub("[.!?]", "", x) if way == 2 else x
        want += [(c, t, "user" if way == 4 else r, x)] * (0 if way == 0 else 2 if way == 3 else 1)
    assert got == sorted(want, key=repr)


def test_nothing_left_and_empty_tables(spark, tmp_path):
    import zlib

    lost = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    spark.createDataFrame([(lost, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    (row,) = repair.op13_repair(spark, str(tmp_path)).collect()
    assert tuple(row)[:8] == (lost, 0, 0, 0, 0, 0, 0, "") and row.repaired_sha256 == hashlib.sha256(b"").hexdigest()
    assert repair.repair(spark.read.parquet(str(tmp_path / "conversations.parquet")).limit(0)).count() == 0
