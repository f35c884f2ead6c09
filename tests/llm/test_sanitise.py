import random
import re
import time
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rasterlake.llm import sanitise

SF = "/root/testdata/sf0.001"
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def good(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base(text):
    return sorted((m.start(), place, kind, m.end()) for place, kind in enumerate(sanitise.KINDS) for m in re.finditer(PLAIN[kind], text or "") if good(kind, m.group()))


def spans_of(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(4)
    return [[tuple(s) for s in r.s] for r in df.select("k", sanitise.base_spans(F.col("text")).alias("s")).orderBy("k").collect()]


def test_op12_sql(spark, same_rows):
    same_rows(sanitise.op12_sanitise(spark, SF), sanitise.OP12_SQL, SF)


def test_base_spans(spark):
    hand = [
        None, "", "é a@b.c_d@e.f x", "a@b@c.d", "a@b.c@d.e", "@b.c", "a@b", "1.2.3.4.5.6.7.8", "1.2.3.256 01.002.0003.4 999.1.1.1", "0000000.0.0.00255", "4111 1111 1111 1111", "4111-1111-1111-1111-",
        "411111111111", "+1 (017) 555-7713 and +12", "+1 .... ", "++12345678 9", "4111111111111111 4111111111111111", "日本 x@y.zz 日 127.0.0.1", "a.b.c.d@e.f.g@h.i", "x@y.z%q@r.s 1-2-3-4-5-6-7-8-9-0-1-2-3",
    ]
    rng = random.Random(5)
    parts = ["a", "b.", "@", ".", "_", "-", "+1", "12", "255", " ", "(", "c@d.ef", "4111111111111111", "1.2.3.4", "é", "%", "\n", "+49 89 123456789"]
    texts = [*hand, *("".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(1500))]
    for text, got in zip(texts, spans_of(spark, texts), strict=True):
        assert got == base(text), text


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.text("ab1 .@+-_()45\n4é", max_size=60), min_size=30, max_size=60))
def test_base_spans_of_any_text(spark, texts):
    assert spans_of(spark, texts) == [base(t) for t in texts]


def test_long_runs_take_linear_time(spark):
    texts = ["a" * 400_000, "a." * 200_000, "1" * 400_000, "1." * 200_000, "a@" + "b." * 200_000 + "c", "+1" + " " * 400_000, "1 " * 200_000, "0" * 300_000 + ".0.0.0"]
    began = time.time()
    got = spans_of(spark, texts)
    df = spark.createDataFrame(list(enumerate([*texts, "a@b.cd " * 20_000, "x@y.z_" * 20_000])), "doc_id long, text string")
    found = {r.doc_id: len(r.spans) for r in sanitise.sanitise(df).select("doc_id", "spans").collect()}
    assert time.time() - began < 60
    assert [len(s) for s in got] == [0, 0, 0, 50_000, 1, 0, 0, 1] and got[3][1] == (8, 1, "ip", 15) and got[4] == [(0, 0, "email", 400_003)]
    assert found[8] == 20_000 and found[9] == 20_000 and found[4] == 1


def brute_terms(texts, reach=10, prefix=3, contexts=3, left=1.0, gain=1.0):
    token = re.compile(rf"(?<![A-Za-z0-9._%+-])(?:{PLAIN['email']})+|{PLAIN['phone']}|{PLAIN['ip']}|{PLAIN['card']}|[0-9A-Za-z\x80-\U0010ffff]+")
    near, around, holds = defaultdict(set), defaultdict(set), defaultdict(set)

    def forms(t):
        t = "".join(c.lower() if c < "\x80" else c for c in t)
        return [t, *([t[:prefix] + "*"] if len(t) > prefix else [])] if re.fullmatch(r"[A-Za-z\x80-\U0010ffff]{2,}", t) else []

    for r, text in enumerate(texts):
        tokens = [m.group() for m in token.finditer(text or "")]
        for t in tokens:
            for f in forms(t):
                holds[f].add(r)
        for i, t in enumerate(tokens):
            kind = "email" if "@" in t else next((k for k in ("ip", "phone", "card") if re.fullmatch(PLAIN[k], t) and good(k, t)), None)
            if kind:
                e, window = (kind, t), tokens[max(0, i - reach) : i + reach + 1]
                near[e, ""].add(r)
                for f in {f for w in window for f in forms(w)}:
                    near[e, f].add(r)
                    around[e, f].add(tuple(window))
    tell = {f for (e, f), rows in near.items() if f and len(around[e, f]) >= contexts and len(rows) * 2**left >= len(holds[f]) and len(rows) * len(texts) >= 2**gain * len(holds[f]) * len(near[e, ""])}
    return {t: None if len(t) <= prefix or t[:prefix] + "*" in tell else t[:prefix] + "*" for t in tell if not t.endswith("*")}


def planted():
    rng = random.Random(3)
    common = ["alpha", "beta", "gamma", "delta", "zorro", "zeta", "theta", "und", "qui", "über"]
    say = lambda n: " ".join(rng.choices(common, k=n))
    texts = [f"{say(rng.randint(15, 40))}" for _ in range(120)]
    texts += [f"{say(12)} Zorblat {say(3)} jo.z@mail.example.org {say(12)}" for _ in range(8)]  # one name, one address
    texts += [f"{say(5)} qqx {say(2)} 10.1.2.3 {say(5)}" for _ in range(5)]  # too short for a prefix
    texts += [f"{say(5)} Wuxolin {say(2)} +49 89 1234567 {say(5)}" for _ in range(5)]  # no other word with its prefix
    texts += [f"copied words rarely seen k@l.mn {common[0]}"] * 30  # one context, however many copies
    texts += [f"{say(20)} zorblat {say(2)}", f"{say(4)} Lonely a1@b.cd", None, "", "zorblat"]  # the name alone still tells
    texts += [f"{say(5)} {w} {say(5)}" for w in ("zornig", "zorilla", "zorbing", "zorba") for _ in range(9)]
    return texts


def test_terms_against_brute_force(spark):
    texts = planted()
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, term string").repartition(6)
    want = brute_terms(texts)
    assert want == {"zorblat": "zor*", "qqx": None, "wuxolin": None}
    assert {r.term: r.instead for r in sanitise.revealing_terms(df).collect()} == want
    for other in ({"reach": 2}, {"contexts": 1, "left": 0.0}, {"contexts": 2, "left": 3.0, "gain": 2.0, "prefix": 4}):
        assert {r.term: r.instead for r in sanitise.revealing_terms(df, **other).collect()} == brute_terms(texts, **other), other
    got = {r.doc_id: r for r in sanitise.redact(sanitise.sanitise(df)).collect()}
    for k, text in enumerate(texts):
        terms = [(m.start(), 4, "term", m.end()) for m in re.finditer("(?i)zorblat|qqx|wuxolin", text or "")]
        assert [tuple(s)[:4] for s in got[k].spans] == sorted(base(text) + terms)
        assert got[k].sanitised is None if text is None else re.search("(?i)zorblat|qqx|wuxolin|@|10[.]1", got[k].sanitised) is None
        assert got[k].text == text and got[k].term == "x"
    assert got[len(texts) - 1 - 36].sanitised == "zor*" and "[email]" in got[120].sanitised and "zor*" in got[120].sanitised and "[term]" in got[128].sanitised


def test_overlaps_are_replaced_once(spark):
    df = spark.createDataFrame([(1, "x +4111 1111 1111 1111. y"), (2, "a@1.2.3.4 z")], "doc_id long, text string")
    got = {r.doc_id: r for r in sanitise.redact(sanitise.sanitise(df)).collect()}
    assert [s.kind for s in got[2].spans] == ["email", "ip"] and got[2].sanitised == "[email] z"
    assert [s.kind for s in got[1].spans] == ["card"] and got[1].sanitised == "x +[card]. y"


def test_empty_tables_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "a@b.cd"), (1, None), (1, None), (2, "a@b.cd")], "doc_id long, text string")
    assert sanitise.sanitise(df.limit(0)).count() == 0
    assert sorted(len(r.spans) for r in sanitise.sanitise(df).collect()) == [0, 0, 1, 1]
    assert sanitise.sanitise(df, keep=["doc_id"]).columns == ["doc_id", "spans"]


def test_filter_passes_every_key_and_few_others(spark):
    keys = spark.range(3000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    test = sanitise.passes(sanitise.filter_bits(keys))
    assert keys.where(test(F.col("key"))).count() == 3000
    assert spark.range(100_000).where(test(F.concat(F.lit("other"), F.col("id")))).count() < 600


def test_no_python_in_plans(spark):
    plan = sanitise.op12_sanitise(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
