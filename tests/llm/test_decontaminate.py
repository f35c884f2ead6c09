import random

import numpy as np
import pytest

from rasterlake.llm import decontaminate
from rasterlake.llm.decontaminate import ItemAutomaton


def brute(ws, items, window):
    hit, found = set(), set()
    for i, iw in items:
        size = min(window, len(iw))
        for a in range(len(iw) - size + 1 if iw else 0):
            for b in range(len(ws) - size + 1):
                if ws[b : b + size] == iw[a : a + size]:
                    hit |= set(range(b, b + size))
                    found.add(i)
    return hit, found


@pytest.mark.parametrize(("shard", "held"), [(250_000, 8), (30, 2), (1, 1)])
def test_one_pass_over_many_automata_by_brute_force(spark, shard, held):
    r = random.Random(shard)
    word = lambda n=6: f"w{r.randint(0, n)}"
    items = [(k // 2, " ".join(word() for _ in range(r.choice([0, 1, 2, 5, 9, 40])))) for k in range(30)] + [(None, "only null"), (3, None)]
    docs = [(k, " ".join(word(9) for _ in range(r.choice([0, 3, 25, 60])))) for k in range(60)] + [(1, None), (2, items[5][1]), (2, items[5][1])]
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, n_hit int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(df, bench, window=4, block_words=shard, held=held, cut=True).collect()
    pieces = [("" if i is None else str(i), (t or "").split()) for i, t in items]
    want = []
    for i, t in docs:
        ws = (t or "").split()
        hit, found = brute(ws, pieces, 4)
        want.append((i, len(ws), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(ws), None if t is None else [w for k, w in enumerate(ws) if k not in hit]))
    assert sorted(map(repr, want)) == sorted(repr((x.doc_id, x.n_words, x.n_hit, x["items"], x.contaminated, None if x.clean_text is None else x.clean_text.split())) for x in got)


def test_size_of_an_automaton_and_long_texts():
    rng = np.random.default_rng(1)
    items = [(str(k), [b"w%d" % x for x in rng.integers(0, 5000, 400)]) for k in range(100)]
    raw = ItemAutomaton.build(items, 13).dump()
    assert len(raw) < 40_000 * 110  # bytes for each item word
    auto = ItemAutomaton.load(raw)
    text = [b"x%d" % k for k in range(300_000)] + items[7][1][50:90] + [b"w1"] * 200_000
    spans, found = auto.scan(text)
    assert spans == [(300_000, 300_040)] and found == {"7"}


def test_spans_that_touch_become_one():
    assert decontaminate.merge_spans([(0, 3), (9, 12)], [(3, 5), (11, 20), (30, 31)]) == [(0, 5), (9, 20), (30, 31)]
