"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors are rotated and split into low-dimensional blocks. If two vectors are within squared distance
``2 - 2 * cosine``, then in at least one of ``b`` blocks they are within a ``b``-th of it. Each block is
range-joined under that budget, and the union of the candidates is verified on the unrotated vectors in
double precision.

The range join of a block goes down an index of balls. Its upper level are cells: a vector belongs to the pivot
nearest to it, and a cell's ball in a block is centred at the pivot's block. Cells whose balls come within the
budget in no block never meet. Cells are cut into tiles of equal size, so a hot cell takes many tasks. The
lower level are leaves of a tile, cut between far ends; only pairs of leaves whose balls come within a block's
budget are compared in that block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterlake.llm.common import connected_components, input_partitions, materialize, table

SLACK = 1e-5  # of single-precision block distances; verification is exact
LEAF = 128


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision; scaling by the largest component first avoids overflow."""
    x = x.astype(np.float64, copy=False)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(d: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))
    return q * np.sign(np.diag(r))


def block_cuts(d: int, width: int) -> list[tuple[int, int]]:
    b = max(1, d // width)
    at = np.linspace(0, d, b + 1).astype(int).tolist()
    return list(zip(at[:-1], at[1:], strict=True))


def leaves(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows in which those of a leaf stand together, and where each leaf begins.

    What exceeds a leaf is cut between two of its far ends, half way, or in the middle where that leaves too little on a side.
    """
    order, begins, todo = np.arange(len(x)), [], [(0, len(x))]
    while todo:
        begin, end = todo.pop()
        if end - begin <= leaf:
            begins.append(begin)
            continue
        mine = order[begin:end]
        one = x[mine[((x[mine] - x[mine[0]]) ** 2).sum(axis=1).argmax()]]
        other = x[mine[((x[mine] - one) ** 2).sum(axis=1).argmax()]]
        along = x[mine] @ (other - one)
        by = np.argsort(along, kind="stable")
        cut = int(np.searchsorted(along[by], ((one + other) / 2) @ (other - one)))
        if min(cut, len(mine) - cut) < leaf // 8:
            cut = len(mine) // 2
        order[begin:end] = mine[by]
        todo += [(begin + cut, end), (begin, begin + cut)]
    return order, np.array(begins)


def balls(x: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and radius of each leaf."""
    sizes = np.diff(np.append(begins, len(x)))
    centre = np.add.reduceat(x, begins, axis=0) / sizes[:, None]
    off = np.sqrt(((x - np.repeat(centre, sizes, axis=0)) ** 2).sum(axis=1))
    return centre, np.maximum.reduceat(off, begins)


def gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the rows of ``a`` and those of ``b``."""
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T), 0))


def join_tiles(a: np.ndarray, b: np.ndarray, cosine: float, width: int, same: bool, begins: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Links between two tiles of unit vectors whose leaves begin at ``begins``: rows, columns and a matrix of links; each pair once if the tile is the ``same``."""
    d = a.shape[1]
    turn, cuts = rotation(d), block_cuts(d, width)
    budget = (2 - 2 * cosine) / len(cuts)
    ra, rb = a @ turn, b @ turn
    left, right, opened = [], [], []
    for i, j in cuts:
        x, y = ra[:, i:j], rb[:, i:j]
        (ca, da), (cb, db) = balls(x, begins[0]), balls(y, begins[1])
        opened.append(gaps(ca, cb) <= da[:, None] + db[None] + sqrt(budget + SLACK) + 1e-6)
        # One product gives minus half the squared distance: each side carries the other's half square as a factor of one.
        hx, hy = (x * x).sum(axis=1, keepdims=True) / 2, (y * y).sum(axis=1, keepdims=True) / 2
        left.append(np.ascontiguousarray(np.hstack([x, np.ones_like(hx), -hx]), dtype=np.float32))
        right.append(np.ascontiguousarray(np.hstack([y, -hy, np.ones_like(hy)]).T, dtype=np.float32))
    sizes = np.diff(np.append(begins[1], len(b)))
    for k, (at, end) in enumerate(zip(begins[0].tolist(), [*begins[0][1:].tolist(), len(a)], strict=True)):
        rows = np.arange(at, end)
        first = at if same else 0
        near = None
        for x, y, ok in zip(left, right, opened, strict=True):
            open_ = ok[k] & (np.arange(len(sizes)) >= k) if same else ok[k]
            if not open_.any():
                continue
            if near is None:
                near = np.zeros((len(rows), len(b) - first), dtype=bool)
            if open_[k if same else 0 :].all():
                near |= x[rows] @ y[:, first:] >= -(budget + SLACK) / 2
            else:
                columns = np.flatnonzero(np.repeat(open_, sizes))
                near[:, columns - first] |= x[rows] @ y[:, columns] >= -(budget + SLACK) / 2
        if near is None:
            continue
        if same:
            near &= np.arange(first, len(b))[None] > rows[:, None]
        columns = np.flatnonzero(near.any(axis=0))
        if not len(columns):
            continue
        some = np.flatnonzero(near.any(axis=1))
        near, columns, rows = near[np.ix_(some, columns)], columns + first, rows[some]
        if np.count_nonzero(near) * 16 >= near.size:
            near &= a[rows] @ b[columns].T >= cosine
        else:
            i, j = np.nonzero(near)
            near[i, j] = np.einsum("ij,ij->i", a[rows[i]], b[columns[j]]) >= cosine
        if near.any():
            yield rows, columns, near


def merge(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``label`` (each at most its own index, and its own label) after joining each ``p`` with its ``q``."""
    while True:
        a, b = label[p], label[q]
        apart = a != b
        if not apart.any():
            return label
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not ((after := label[label]) == label).all():
            label = after


def spread(label: np.ndarray, rows: np.ndarray, columns: np.ndarray, links: np.ndarray) -> np.ndarray:
    """``label`` after joining what a matrix of links joins; each round takes the least label that each row and column sees."""
    while True:
        a, b = label[rows], label[columns]
        if not (links & (a[:, None] != b[None])).any():
            return label
        seen = np.where(links, b[None], len(label)), np.where(links, a[:, None], len(label))
        i, j = np.flatnonzero(links.any(axis=1)), np.flatnonzero(links.any(axis=0))
        label = merge(label, np.concatenate([rows[i], columns[j]]), np.concatenate([columns[seen[0][i].argmin(axis=1)], rows[seen[1][:, j].argmin(axis=0)]]))


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, width: int = 16, tile: int = 16_384, max_pivots: int = 1024) -> DataFrame:
    """Links and components of vectors whose cosine in double precision is at least ``cosine``.

    Returns ``key``, ``n_links`` (other rows linked directly), ``component_id`` (smallest key reachable by links,
    itself included) and ``kept`` (the key is that smallest one). Vectors that are null, empty or zero, or hold a
    null or non-finite component, link with nothing, and vectors of different lengths do not link. Every row gives a
    row; equal vectors, repeated rows among them, are joined once and weighted. Other columns are not read, whatever
    their names. A null key is never the smallest if there is another, and is not kept. An empty table gives no rows.

    All pairs within the budget of some block are verified: no link is lost. Vectors are told apart by 128 bits of
    a digest. ``max_pivots`` bounds the cells of a length, and with them what is sent to every task (at most its square
    in pairs of cells); ``tile`` bounds the vectors of a tile. A pair of tiles is a task; there are enough tiles for
    every partition to get a pair. Where cells do not separate, work grows with the square of the vectors.
    """
    spark = df.sparkSession
    single = isinstance(df.schema[vector].dataType.elementType, T.FloatType)
    item, kind = (4, np.float32) if single else (8, np.float64)
    x = F.col("v")
    good = x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(x, lambda e: e != 0)
    cast = df.select(df[key].alias("key"), (df[vector] if single else df[vector].cast("array<double>")).alias("v"))
    cast = cast.select("key", F.when(good, x).alias("v"))
    key_type = dict(cast.dtypes)["key"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            values, at, is_set = column.values.to_numpy(zero_copy_only=False) + kind(0), column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
            raw = [values[at[i] : at[i + 1]].tobytes() if ok else None for i, ok in enumerate(is_set)]
            digest = [None if v is None else hashlib.blake2b(v, digest_size=16).digest() for v in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], ["key", "digest", "v"])

    rows = materialize(cast.mapInArrow(read, f"key {key_type}, digest binary, v binary"))
    sets = rows.where("digest is not null").groupBy("digest").agg(F.min("key").alias("least"), F.count("*").alias("w"), F.min("v").alias("v"))
    sets = materialize(sets.withColumn("d", (F.octet_length("v") / item).cast("int")).withColumn("sid", F.monotonically_increasing_id()))
    many = {r.d: r["count"] for r in sets.groupBy("d").count().collect()}  # one row for each length of vector
    parts = input_partitions(df)
    size = {d: max(1, min(tile, ceil(n / ceil(sqrt(2 * parts))))) for d, n in many.items()}
    sampled = spark.createDataFrame([(d, n, min(max_pivots, ceil(n / (2 * size[d])))) for d, n in many.items() if n > size[d]], "d int, n long, want int")
    chosen = sets.join(F.broadcast(sampled), "d").where(F.pmod(F.xxhash64("sid"), F.col("n")) < F.col("want")).select("d", "v").collect()
    pivots = {d: unit(np.array([np.frombuffer(r.v, kind) for r in chosen if r.d == d]).reshape(-1, d)) for d in {r.d for r in chosen}}
    sent = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector's cell; and for each cell, in a row without ``sid``, how far its vectors are from the pivot in each block and in all."""
        for batch in batches:
            sid, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            d = np.array([len(v) // item for v in raw], dtype=np.int32)
            for k in np.unique(d).tolist():
                mine = np.flatnonzero(d == k)
                u = unit(np.frombuffer(b"".join(raw[i] for i in mine), kind).reshape(-1, k))
                centre = sent.value.get(k)
                cell = np.zeros(len(mine), dtype=np.int32) if centre is None else np.argmax(u @ centre.T, axis=1).astype(np.int32)
                here = np.unique(cell)
                reach: list = []
                if centre is not None:
                    off = (u - centre[cell]) @ rotation(k)
                    far = np.stack([np.sqrt((off[:, i:j] ** 2).sum(axis=1)) for i, j in [*block_cuts(k, width), (0, k)]], axis=1)
                    reach = [far[cell == c].max(axis=0).tolist() for c in here]
                n = len(here)
                columns = [pa.array([*sid[mine], *[None] * n], pa.int64()), pa.array(np.full(len(mine) + n, k, dtype=np.int32)), pa.array(np.concatenate([cell, here]).astype(np.int32)), pa.array([*[None] * len(mine), *(reach or [[]] * n)], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["sid", "d", "cell", "reach"])

    placed = materialize(sets.select("sid", "v").mapInArrow(place, "sid long, d int, cell int, reach array<double>"))
    counted = placed.where("sid is not null").groupBy("d", "cell").count().orderBy("d", "cell").collect()
    radii = placed.where("sid is null").select("d", "cell", F.posexplode("reach").alias("k", "r")).groupBy("d", "cell", "k").agg(F.max("r").alias("r")).orderBy("d", "cell", "k").collect()
    cells: dict[int, list[tuple[int, int, int]]] = {}  # by length: cell, its first tile, its tiles; bounded by max_pivots
    total = 0
    for r in counted:
        cells.setdefault(r.d, []).append((r.cell, total, ceil(r["count"] / size[r.d])))
        total += cells[r.d][-1][2]
    mates = spark.sparkContext.broadcast({d: _meeting(own, pivots.get(d), np.array([r.r for r in radii if r.d == d]).reshape(len(own), -1), d, cosine, width) for d, own in cells.items()})
    tasks_ = sum(_tasks(own, mates.value[d]) for d, own in cells.items())
    where = spark.createDataFrame([(d, c, n, base) for d, own in cells.items() for c, base, n in own], "d int, cell int, pieces int, base int")
    tiled = placed.where("sid is not null").join(F.broadcast(where), ["d", "cell"]).select("sid", "d", "cell", (F.col("base") + F.pmod(F.xxhash64("sid"), F.col("pieces"))).cast("int").alias("tile"))
    packed = tiled.join(sets.select("sid", "w", "v"), "sid").repartitionById(max(parts, min(total, 100_000)), F.pmod("tile", F.lit(max(parts, min(total, 100_000))))).sortWithinPartitions("tile")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            d, cell = held[0][1], held[0][2]
            m = np.frombuffer(b"".join(h[4] for h in held), kind).reshape(-1, d)
            order, begins = leaves(unit(m) @ rotation(d))
            sid, w = (np.array([h[k] for h in held], dtype=np.int64)[order] for k in (0, 3))
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((now, d, cell, sid.tobytes(), w.tobytes(), m[order].tobytes(), begins.astype(np.int64).tobytes()), (pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], ["tile", "d", "cell", "sids", "ws", "m", "leaves"])

        for batch in batches:
            for t, *rest in zip(*(batch.column(c).to_pylist() for c in ("tile", "sid", "d", "cell", "w", "v")), strict=True):
                if t != now and held:
                    yield done()
                    held.clear()
                now = t
                held.append(rest)
        if held:
            yield done()

    tiles = materialize(packed.select("sid", "tile", "d", "cell", "w", "v").mapInArrow(pack, "tile int, d int, cell int, sids binary, ws binary, m binary, leaves binary"), "uncompressed")
    spots = max(1, min(max(parts, tasks_), 100_000))

    def partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A copy of the tile for each tile that it meets."""
        for batch in batches:
            for k in range(batch.num_rows):
                t, d, cell = (batch.column(c)[k].as_py() for c in range(3))
                for begin, end in mates.value[d][cell]:
                    for u in range(begin, end):
                        i, j = min(t, u), max(t, u)
                        yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in ((j * (j + 1) // 2 + i) % spots, i, j)), *(batch.column(c).slice(k, 1) for c in (0, 1, 3, 4, 5, 6))], ["p", "i", "j", "tile", "d", "sids", "ws", "m", "leaves"])

    tasks = tiles.mapInArrow(partners, "p int, i int, j int, tile int, d int, sids binary, ws binary, m binary, leaves binary")
    tasks = tasks.repartitionById(spots, "p").sortWithinPartitions("i", "j", "tile").drop("p")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            for k in range(batch.num_rows):
                i, j, t, d, sids, ws, m, at = (batch.column(c)[k].as_py() for c in range(8))
                now = (np.frombuffer(sids, np.int64), np.frombuffer(ws, np.int64), np.frombuffer(m, kind).reshape(-1, d), np.frombuffer(at, np.int64))
                if i == j:
                    yield links(now, now, True)
                elif t == i:
                    held = now
                else:
                    yield links(held, now, False)

    def links(a: tuple, b: tuple, same: bool) -> pa.RecordBatch:
        na = len(a[0])
        shift = 0 if same else na
        degree, label = np.zeros(na + (0 if same else len(b[0]))), np.arange(na + (0 if same else len(b[0])))
        ua = unit(a[2])
        for p, q, ok in join_tiles(ua, ua if same else unit(b[2]), cosine, width, same, (a[3], b[3])):
            degree[p] += ok @ b[1][q].astype(np.float64)
            degree[q + shift] += a[1][p].astype(np.float64) @ ok
            label = spread(label, p, q + shift, ok)
        sids = a[0] if same else np.concatenate([a[0], b[0]])
        has = np.flatnonzero(degree)
        return pa.RecordBatch.from_arrays([pa.array(sids[has]), pa.array(sids[label[has]]), pa.array(degree[has].astype(np.int64))], ["a", "b", "degree"])

    found = materialize(tasks.mapInArrow(join, "a long, b long, degree long"))
    degree = found.groupBy(F.col("a").alias("sid")).agg(F.sum("degree").alias("degree"))
    linked = connected_components(found.select("a", "b"))
    named = sets.select("digest", "sid", "least", "w").join(degree, "sid", "left").join(linked.withColumnRenamed("node", "sid"), "sid", "left")
    named = materialize(named.select("digest", "least", (F.col("w") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"), F.coalesce("component", "sid").alias("component")))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    final = materialize(named.join(lowest, "component").select("digest", "n_links", "component_id"))
    out = rows.select("key", "digest").join(final, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))


def _meeting(own: list[tuple[int, int, int]], centres: np.ndarray | None, reach: np.ndarray, d: int, cosine: float, width: int) -> dict[int, list[tuple[int, int]]]:
    """For each cell, runs of tiles of the cells that it meets, itself included: balls within the budget in some block and in all of them."""
    n = len(own)
    meet = np.ones((n, n), dtype=bool)
    if centres is not None and n > 1:
        at = centres[[c for c, _, _ in own]] @ rotation(d)
        cuts = block_cuts(d, width)
        near = [gaps(at[:, i:j], at[:, i:j]) <= reach[:, k, None] + reach[None, :, k] + sqrt((2 - 2 * cosine) * (1 / len(cuts) if k < len(cuts) else 1) + SLACK) + 1e-6 for k, (i, j) in enumerate([*cuts, (0, d)])]
        meet = np.logical_or.reduce(near[:-1]) & near[-1] | np.eye(n, dtype=bool)
    out: dict[int, list[tuple[int, int]]] = {}
    for k, (cell, _, _) in enumerate(own):
        runs: list[tuple[int, int]] = []
        for m in np.flatnonzero(meet[k]).tolist():
            _, base, pieces = own[m]
            if runs and runs[-1][1] == base:
                runs[-1] = (runs[-1][0], base + pieces)
            else:
                runs.append((base, base + pieces))
        out[cell] = runs
    return out


def _tasks(own: list[tuple[int, int, int]], mates: dict[int, list[tuple[int, int]]]) -> int:
    """How many pairs of tiles meet."""
    return (sum(n * sum(end - begin for begin, end in mates[cell]) for cell, _, n in own) + sum(n for _, _, n in own)) // 2


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all rows of ``embeddings``; see ``near_vectors`` for nulls, repeated rows and empty tables."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS MATERIALIZED (
  SELECT * FROM e WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(v, lambda x: x <> 0)) > 0),
pair AS MATERIALIZED (
  SELECT a.r AS x, b.r AS y FROM good a JOIN good b ON a.r <> b.r AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.9),
reach(x, y) AS (SELECT r, r FROM e UNION SELECT reach.x, pair.y FROM reach JOIN pair ON reach.y = pair.x),
c AS (SELECT x, min(e.vec_id) AS component_id FROM reach JOIN e ON e.r = reach.y GROUP BY x)
SELECT e.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c.component_id, coalesce(e.vec_id = c.component_id, false) AS kept
FROM e JOIN c ON c.x = e.r LEFT JOIN (SELECT x, count(*) AS n FROM pair GROUP BY x) d ON d.x = e.r
"""
