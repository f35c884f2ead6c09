import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterlake.llm import embeddings


def brute(m, ids, cosine=0.9):
    u = embeddings.unit(m)
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    label = np.arange(len(m))
    while True:
        low = np.minimum(label, np.where(near, label[None], len(m)).min(axis=1))
        if (low == label).all():
            break
        label = low
    least = np.full(len(m), np.iinfo(np.int64).max)
    np.minimum.at(least, label, ids)
    return {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(axis=1), least[label], strict=True)}


def planted(n=10_500, d=64, seed=4):
    """Random vectors, a third of them near copies of one, a chain, small groups, and pairs on either side of the threshold."""
    rng = np.random.default_rng(seed)
    m = embeddings.unit(rng.normal(size=(n, d)))
    m[: n // 3] = embeddings.unit(m[:1] + rng.normal(size=(n // 3, d)) * 0.035)
    for k in range(4000, 4060):  # a chain: each near the next alone
        m[k] = embeddings.unit((m[k - 1] + 0.45 * m[k])[None])[0]
    for k in range(5000, 6000, 5):
        m[k + 1 : k + 5] = embeddings.unit(m[k : k + 1] + rng.normal(size=(4, d)) * 0.04)
    for k in range(7000, 7400, 2):  # cosines from 0.89 to 0.91
        c = 0.89 + 0.02 * (k - 7000) / 400
        away = m[k + 1] - (m[k + 1] @ m[k]) * m[k]
        m[k + 1] = c * m[k] + np.sqrt(1 - c * c) * away / np.linalg.norm(away)
    return (m * rng.uniform(0.1, 9, (n, 1))).astype(np.float32), rng.permutation(n)


@pytest.mark.parametrize("tile", [16_384, 700])
def test_planted_links_in_a_large_table(spark, tile):
    m, ids = planted()
    df = spark.createDataFrame([(int(i), v.tolist(), "x") for i, v in zip(ids, m, strict=True)], "vec_id long, embedding array<float>, component_id string")
    want = brute(m, ids)
    assert sum(n > 0 for n, _ in want.values()) > 4500
    got = embeddings.near_vectors(df, tile=tile).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want and all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_leaves_that_cannot_link_are_not_compared():
    """Groups far apart: of the pairs of leaves of a block, few come within its budget."""
    rng = np.random.default_rng(8)
    centre = embeddings.unit(rng.normal(size=(16, 64)))
    u = embeddings.unit(np.repeat(centre, 500, axis=0) + rng.normal(size=(8000, 64)) * 0.02)
    u = u[rng.permutation(8000)]
    turned = u @ embeddings.rotation(64)
    order, begins = embeddings.leaves(turned)
    assert sorted(order) == list(range(8000)) and np.diff([*begins, 8000]).max() <= embeddings.LEAF
    open_ = 0
    for i, j in embeddings.block_cuts(64, 16):
        c, r = embeddings.balls(turned[order][:, i:j], begins)
        open_ += int((embeddings.gaps(c, c) <= r[:, None] + r[None] + np.sqrt(0.05)).sum())
    assert open_ < 4 * len(begins) ** 2 / 4
    links = sum(int(ok.sum()) for _, _, ok in embeddings.join_tiles(u[order], u[order], 0.9, 16, True, (begins, begins)))
    near = u @ u.T >= 0.9
    assert links == (near.sum() - len(u)) // 2


def test_cells_that_cannot_meet_form_no_pairs():
    rng = np.random.default_rng(3)
    centre = embeddings.unit(np.eye(8, 64) + rng.normal(size=(8, 64)) * 0.01)
    own = [(k, k * 2, 2) for k in range(8)]
    tight = embeddings._meeting(own, centre, np.full((8, 5), 0.01), 64, 0.9, 16)
    assert tight == {k: [(2 * k, 2 * k + 2)] for k in range(8)} and embeddings._tasks(own, tight) == 8 * 3
    wide = embeddings._meeting(own, centre, np.full((8, 5), 1.0), 64, 0.9, 16)
    assert wide == {k: [(0, 16)] for k in range(8)} and embeddings._tasks(own, wide) == 16 * 17 // 2


def test_ties_repeated_rows_and_clashing_names(spark):
    v = [0.6, 0.8] + [0.0] * 14
    rows = [(1, v, "a", 1), (1, v, "a", 1), (2, v, "b", 2), (3, [-x for x in v], "c", 3), (4, [0.0, -0.0] + [0.0] * 14, "d", 4), (5, [1.0] + [0.0] * 15, "e", 5), (6, [1.0, -0.0] + [0.0] * 14, "e", 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, digest string, sid int")
    got = sorted(tuple(r) for r in embeddings.near_vectors(df).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False)]
    assert embeddings.near_vectors(df.withColumn("v", F.lit(1))).columns == ["vec_id", "n_links", "component_id", "kept"]
