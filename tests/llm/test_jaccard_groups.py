import numpy as np
import pytest

from rasterlake.llm import jaccard
from test_other_operators import brute_jaccard


def key(r):
    return tuple(-1 if x is None else x for x in r)


def chain(n, words=40, step=3):
    """Texts that slide over one long run of words: each links with its neighbours alone, all are one component."""
    run = [f"c{k}" for k in range(words + step * n)]
    return [" ".join(run[k * step : k * step + words]) for k in range(n)]


def near_copies(n, seed, words=60, change=4):
    rng = np.random.default_rng(seed)
    base = [f"b{seed}_{k}" for k in range(words)]
    out = []
    for _ in range(n):
        now = list(base)
        for at in rng.choice(words, int(rng.integers(0, change)), replace=False):
            now[at] = f"x{rng.integers(0, 60)}"
        out.append(" ".join(now))
    return out


def passages(n, seed):
    """Texts put together from a few shared passages: candidates of one another, most of them without a link."""
    rng = np.random.default_rng(seed)
    parts = [" ".join(f"p{k}_{j}" for j in range(14)) for k in range(9)]
    return [" ".join(parts[k] for k in rng.choice(9, 5)) for _ in range(n)]


@pytest.mark.parametrize("settings", [{}, {"piece": 8, "pivots": 2}, {"piece": 5, "pivots": 0}, {"block": 300, "most_frequent": 3, "frequent": 5}])
def test_large_components_by_brute_force(spark, settings):
    texts = [*chain(60, step=1), *near_copies(90, 1), *near_copies(40, 2, change=14), *passages(80, 3), *["w x y z"] * 5, None, "", "one two"]
    rows = list(enumerate(texts))
    want = brute_jaccard(rows)
    assert len({c for _, _, c in want}) < len(rows) - 100
    df = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, digest string, n int").repartition(5)
    got = jaccard.near_duplicates(df, **settings).collect()
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_one_giant_component(spark):
    """A chain of 1500 texts, cut into pieces of 64; no step pairs all of them."""
    rows = list(enumerate(chain(1500, words=50, step=2)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.near_duplicates(df, piece=64).collect()
    assert {(r.n_shingles, r.component_id) for r in got} == {(46, 0)} and len(got) == 1500


def test_known_components_are_not_verified_again():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 62, 40).astype(np.uint64)) for _ in range(30)]
    n = np.array([len(s) for s in sets])
    known = np.arange(30) // 10
    assert jaccard.link_group(sets, n, 80, 100, known).tolist() == [0] * 10 + [10] * 10 + [20] * 10
    sets[25] = sets[4]
    assert jaccard.link_group(sets, n, 80, 100, known).tolist() == [0] * 10 + [10] * 10 + [0] * 10


def test_very_long_texts_and_groups(spark):
    long = " ".join(f"w{k % 30_011}" for k in range(120_000))
    rows = [(1, long), (2, long + " tail"), (3, "short text of five words"), (3, "short text of five words"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.near_duplicates(df, group="g", carry=["text"]).collect()
    by = {}
    for r in got:
        by.setdefault(None if r.g is None else bytes(r.g), []).append((r.doc_id, r.n_shingles, r.component_id))
    assert by.pop(None) == [(None, 0, None)]
    assert sorted(sorted(v) for v in by.values()) == [[(1, 30_011, 1), (2, 30_012, 1)], [(3, 1, 3), (3, 1, 3)]]


def test_sets_that_share_half_a_digest():
    a, b, c = b"12345678abcdefgh", b"12345678hgfedcba", b"87654321abcdefgh"
    ids = jaccard._ids([a, b, c], frozenset([b]))
    assert len(set(ids.tolist())) == 3 and jaccard._ids([a, b], frozenset()).tolist() == [ids[0]] * 2
    assert jaccard._ids([], frozenset([a])).tolist() == []


def test_equal_first_halves_change_nothing(spark, monkeypatch):
    """Every digest made to clash: sets travel under the second half then."""
    rows = list(enumerate([*near_copies(20, 1), *passages(10, 3), "w x y z"]))
    real = jaccard.F.substring
    monkeypatch.setattr(jaccard.F, "substring", lambda c, at, n: jaccard.F.lit(b"x") if c == "digest" else real(c, at, n))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(key, jaccard.near_duplicates(df).collect())) == sorted(map(key, brute_jaccard(rows)))
