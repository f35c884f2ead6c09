import hashlib
import math
import re
import zlib
from collections import Counter

from rasterlake.llm import resample

SF = "/root/testdata/sf0.001"


def brute(docs, target, buckets, percent, least, seed):
    lower = str.maketrans(resample.UPPER, resample.LOWER)

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(lower))
        return len(w), [zlib.crc32(f.encode()) % buckets for f in [*w, *map(" ".join, zip(w, w[1:], strict=False))]]

    raw, goal = Counter(), Counter()
    for _, t in docs:
        raw.update(features(t)[1])
    for t in target:
        goal.update(features(t)[1])
    s, t = raw.total(), goal.total()
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in range(buckets)]
    rows = []
    for k, text in docs:
        n, f = features(text)
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = place
    return sorted(map(tuple, rows), key=repr)


def test_op11_sql(spark, same_rows):
    same_rows(resample.op11_resample(spark, SF), resample.OP11_SQL, SF)


def test_against_brute_force(spark):
    long = " ".join(f"Wort{k % 97} ÄRA été" for k in range(4000))
    docs = [(1, "The cat SAT. the Cat"), (2, None), (3, ""), (4, "\x01 ... \n"), (5, "x"), (5, "x"), (None, "a b c d e f"), (None, "a b c d e f"), (None, None), (6, long), (7, "ß-É é 日本 9"), (8, "q " * 50)]
    docs += [(k, f"the cat {k} sat on mat {k % 3}") for k in range(20, 60)]
    target = ["The cat sat on a mat", None, ""]
    frame = spark.createDataFrame([(k, t, "x", k) for k, t in docs], "doc_id long, text string, score string, rank long").repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for runs_of in (dict(buckets=10_000, percent=25, least_words=5), dict(buckets=7, percent=60, least_words=0)):
        got = resample.resample(frame, goal, **runs_of)
        assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, target, runs_of["buckets"], runs_of["percent"], runs_of["least_words"], 7)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    goal = docs.select("text")
    assert resample.resample(docs.limit(0), goal).count() == 0
    got = {r.doc_id: r for r in resample.resample(docs, goal.limit(0), percent=100, least_words=1).collect()}
    assert got[1].rank == 1 and got[2].rank is None and got[2].weight == 0
    assert resample.draw(spark.createDataFrame([(None, 1, 1, 0, 5)] * 9, "k int, n_words int, n_features int, weight int, score int"), "k", 50, 1).where("rank > 0").count() == 4


def test_scoring_moves_no_text_and_literal_is_folded(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = resample.weighted(docs, [3, 1, 2], "text", 2, "doc_id")._jdf.queryExecution().executedPlan().toString()
    assert "[3,1,2]" in plan and "split" not in plan and "Exchange" not in plan and "Python" not in plan
    counted = resample.bucket_counts(docs, "text", 2, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert counted.count("regexp_extract_all") == 1
