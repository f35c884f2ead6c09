"""Exact n-gram Jaccard self-join with a count-vector R-tree.

Shingles are hashed into groups; the counts per group make each set a point. For two points the sum of the
coordinate minima bounds the overlap from above, and so does the sum over a point and the upper corner of a
box, so an R-tree over the points leaves few pairs, which are verified on the whole sets.

What surrounds the tree only decides which sets meet in one tree, and loses no pair:

1. Exact copies of a set become one. A set that takes part in a link shares at least ``threshold`` of its
   shingles with other sets, so sets that share less go; the shingle counts that show this come from one shuffle
   of six bytes a shingle.
2. Ordered from rare to frequent, two linked sets share one of the first ``n - ceil(threshold * n) + 1``
   shingles. Sets that share such a shingle are joined (as a star, not as pairs) into candidate components.
3. Candidate components are cut into pieces of bounded size, and each piece gets its tree. A few sets of a
   component, its pivots, go into all of its pieces, so a large group of near copies comes together in linear work.
4. What a cut parts: of the rare shingles of a component with several pieces, only those whose sets step 3 left in
   different components can hold another link. The sets of such a shingle meet in trees again, those of its
   largest component spread over pieces, the others in each of them; pairs already joined are not compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm.common import begin_task, connected_components, holds, input_partitions, materialize, table

_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    """64-bit hashes of words; forgets them when too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()
holds("jaccard", _HASHES.clear)


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; all words as one if there are fewer than k."""
    ws = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not ws:
        return np.empty(0, dtype=np.uint64)
    a = np.fromiter(map(_HASHES.__getitem__, ws), dtype=np.uint64, count=len(ws))
    size = min(k, len(ws))
    n = len(ws) - size + 1
    h = a[:n] + np.uint64(size)
    for j in range(1, size):
        h = (h ^ (h >> np.uint64(29))) * _MIX + a[j : j + n]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h ^= h >> np.uint64(29)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def _set_id(h: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


class CountTree:
    """R-tree over the count vectors of ``sets``, packed by size and then by the coordinate that varies most.

    ``n`` are the sizes of the whole sets; ``sets`` may leave out shingles that no other set has.
    """

    FAN = 16

    def __init__(self, sets: list[np.ndarray], n: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        groups = 1 << int(np.clip(np.ceil(np.log2(np.median(n) + 1)), 4, 10))
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        counts = np.bincount(owner * groups + ((flat >> np.uint64(20)) & np.uint64(groups - 1)).astype(np.int64), minlength=len(sets) * groups).reshape(-1, groups)
        counts = counts.astype(np.uint8 if counts.max() < 256 else np.uint16 if counts.max() < 65536 else np.int64)
        slab = np.argsort(np.argsort(n, kind="stable"), kind="stable") // self.FAN**2
        widest = int(np.argmax(counts.var(axis=0)))
        self.order = np.lexsort((counts[:, widest], slab))
        self.points, self.n = counts[self.order], n[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        hi, low, high = self.points, self.n, self.n
        while len(hi) > self.FAN:
            at = np.arange(0, len(hi), self.FAN)
            hi, low, high = (f.reduceat(x, at, axis=0) for f, x in ((np.maximum, hi), (np.minimum, low), (np.maximum, high)))
            self.levels.append((hi, low, high))

    def spans(self, label: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Least and greatest label (by position) below each node, for each level."""
        low, high, out = label, label, []
        for _ in self.levels:
            at = np.arange(0, len(low), self.FAN)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            out.append((low, high))
        return out

    def near(self, q: int, label: np.ndarray | None = None, spans: list[tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose overlap with position ``q`` may reach the threshold, and that bound.

        With ``label`` and its ``spans``, only later positions of another label than that of ``q``: nodes in which
        there is none are not opened.
        """
        point, n = self.points[q], int(self.n[q])
        rows = np.arange(len(self.levels[-1][0]) if self.levels else len(self.points))
        for k in range(len(self.levels) - 1, -1, -1):
            if label is not None:
                least, most = (x[rows] for x in spans[k])
                rows = rows[((least != label[q]) | (most != label[q])) & ((rows + 1) * self.FAN ** (k + 1) > q + 1)]
            hi, low, high = (x[rows] for x in self.levels[k])
            bound = np.minimum(hi, point).sum(axis=1, dtype=np.int64)
            ok = self._may(bound, n, low) & (high * self.den >= n * self.num) & (low * self.num <= n * self.den)
            below = (rows[ok][:, None] * self.FAN + np.arange(self.FAN)).ravel()
            rows = below[below < len(self.levels[k - 1][0] if k else self.points)]
        if label is not None:
            rows = rows[(rows > q) & (label[rows] != label[q])]
        rows = rows[(self.n[rows] * self.den >= n * self.num) & (self.n[rows] * self.num <= n * self.den)]
        bound = np.minimum(self.points[rows], point).sum(axis=1, dtype=np.int64)
        ok = self._may(bound, n, self.n[rows])
        return rows[ok], bound[ok]

    def _may(self, overlap: np.ndarray, n: int, m: np.ndarray) -> np.ndarray:
        """``overlap / (n + m - overlap) >= num / den`` in integers."""
        return overlap * (self.den + self.num) >= (n + m) * self.num


def link_group(sets: list[np.ndarray], n: np.ndarray, num: int, den: int, known: np.ndarray | None = None) -> np.ndarray:
    """Index of the first member of each set's component under verified links; pairs inside a component are not verified again.

    Sets with the same value of ``known`` are joined beforehand.
    """
    root = np.arange(len(sets))
    if len(sets) < 2:
        return root
    tree = CountTree(sets, n, num, den)
    label = np.arange(len(sets))  # by position
    if known is not None:
        _, at, of = np.unique(known[tree.order], return_index=True, return_inverse=True)
        label = at[of]
    held = [sets[i] for i in tree.order]
    spans, joined = tree.spans(label), False
    for q in range(len(held)):
        if joined:
            spans, joined = tree.spans(label), False
        rows, bound = tree.near(q, label, spans)
        rows = rows[np.argsort(-bound, kind="stable")]
        step = 1
        while len(rows := rows[label[rows] != label[q]]):
            take, rows = rows[:step], rows[step:]
            step = min(step * 4, 256)
            flat = np.concatenate([held[j] for j in take])
            at = np.searchsorted(held[q], flat)
            same = held[q][np.minimum(at, len(held[q]) - 1)] == flat
            begins = np.cumsum([0, *(len(held[j]) for j in take[:-1])])
            overlap = np.add.reduceat(same.astype(np.int64), begins)
            for j in take[tree._may(overlap, int(tree.n[q]), tree.n[take])]:
                if label[j] != label[q]:
                    a, b = sorted((label[j], label[q]))
                    label[label == b] = a
                    joined = True
    first: dict[int, int] = {}
    for position in np.argsort(tree.order, kind="stable"):
        first.setdefault(int(label[position]), int(tree.order[position]))
    root[tree.order] = [first[int(x)] for x in label]
    return root


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, threshold: tuple[int, int] = (80, 100), frequent: int = 2000, most_frequent: int = 250_000, piece: int = 256, block: int = 4_000_000, pivots: int = 4, carry: list[str] | None = None, group: str | None = None) -> DataFrame:
    """Components of documents linked by Jaccard similarity of at least ``threshold`` on ``k``-word shingles.

    Returns ``key``, ``n_shingles`` (long), ``component_id`` (smallest key reachable by links, itself included)
    and the columns of ``carry``; if ``group`` is given, also a column of that name which tells components apart even
    where keys are repeated (null without shingles). Null, empty and wordless texts have no shingles and link with nothing; a text
    with fewer than ``k`` words is one shingle. Every input row gives a row, repeated keys and texts too; a null
    key never names a component unless nothing else does. Other columns are not read, whatever their names. An empty table gives none.

    ``frequent``: a shingle in more than one of so many documents counts as frequent; ``most_frequent`` bounds how many of
    those are broadcast, the most frequent first, and not shuffled. The others are shuffled like all. Neither changes a result.
    ``piece`` and ``block``: sets and shingles in a piece of a candidate component at most (pivots, ``pivots`` of them to be
    expected, and a single longer set come on top). Sets are told apart by 128 bits of a digest, of which 64 travel with their shingles (other ones where two sets share them), shingles by 64 bits of a hash,
    of which 48 and the partition that all 64 choose are kept.
    """
    spark = docs.sparkSession
    num, den = threshold
    source = docs.select(docs[key].alias("key"), docs[text].alias("t"), *[docs[c].alias(f"__c_{c}") for c in carry or []])
    extra = [f for f in source.schema.fields[2:]]
    types = dict(source.dtypes)
    described = ", ".join(["key " + types["key"], *(f"`{f.name}` {f.dataType.simpleString()}" for f in extra), "n long", "digest binary", "h long", "c long"])

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sizes and digests; and shingles that are in several sets of a window of this task, in rows of their own."""
        begin_task("jaccard")
        names = ["key", *(f.name for f in extra), "n", "digest", "h", "c"]
        window: dict[bytes, np.ndarray] = {}
        held, rest_types = 0, [pa.null()] * (1 + len(extra))

        def often() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(list(window.values())), return_counts=True)
            many = c > max(1, len(window) / frequent)
            m = int(many.sum())
            return pa.RecordBatch.from_arrays([*(pa.nulls(m, t) for t in rest_types), pa.nulls(m, pa.int64()), pa.nulls(m, pa.binary()), pa.array(h[many].view(np.int64)), pa.array(c[many])], names)

        for batch in batches:
            got = [shingles(v.as_py(), k) for v in batch.column(1)]
            rest = [batch.column(0), *(batch.column(i) for i in range(2, batch.num_columns))]
            rest_types = [a.type for a in rest]
            digests = [_set_id(g) if len(g) else None for g in got]
            nulls = pa.nulls(len(got), pa.int64())
            yield pa.RecordBatch.from_arrays([*rest, pa.array([len(g) for g in got], pa.int64()), pa.array(digests, pa.binary()), nulls, nulls], names)
            for d, g in zip(digests, got, strict=True):
                if d is not None and d not in window:
                    window[d] = g
                    held += len(g)
            if held >= 1_000_000:
                yield often()
                window, held = {}, 0
        if window:
            yield often()

    first = materialize(source.mapInArrow(describe, described))
    rows = first.where("n is not null").drop("h", "c")
    count = rows.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    heavy = first.where("h is not null").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") > max(8, count.docs / frequent))
    heavy = heavy.orderBy(F.desc("c"), "h").limit(most_frequent).toArrow()
    heavy_h, heavy_c = (heavy.column(c).to_numpy() for c in ("h", "c"))
    order = np.argsort(heavy_h.view(np.uint64))
    sent = spark.sparkContext.broadcast((heavy_h.view(np.uint64)[order], np.minimum(heavy_c[order], (1 << 32) - 1).astype(np.uint32)))
    half = F.substring("digest", 1, 8)
    twice = rows.where("digest is not null").groupBy(half.alias("half")).agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b")
    clashing = spark.sparkContext.broadcast(frozenset(bytes(r.b) for r in twice.select("b").collect()))  # hardly ever any: n * n / 2**65 of n sets
    parts = max(input_partitions(docs), ceil(count.n / 2_500_000))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shingles by the partition that counts them; a row holds those of many sets, so its cost does not grow with the partitions."""
        heavy_h, heavy_c = sent.value

        def flush(sids: list[bytes], sets_: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            sid = _ids(sids, clashing.value)
            n = np.array([len(h) for h in sets_])
            h, owner = np.concatenate(sets_), np.repeat(np.arange(len(sets_)), n)
            p = (h % np.uint64(parts)).astype(np.int64)
            hot = np.zeros(len(h), dtype=bool)
            packed = np.empty(0, dtype=_PACKED)
            if len(heavy_h):
                at = np.minimum(np.searchsorted(heavy_h, h), len(heavy_h) - 1)
                hot = heavy_h[at] == h
                packed = _pack(_key(h[hot], p[hot]), heavy_c[at[hot]])
            owed = np.concatenate(([0], np.cumsum(np.bincount(owner[hot], minlength=len(sid)))))
            home = sid % parts
            rows_ = []
            for g in np.unique(home).tolist():  # each set's size and frequent shingles go straight to where it is put together
                mine = np.flatnonzero(home == g)
                heads = np.stack([n[mine], owed[mine + 1] - owed[mine]], axis=1).astype(np.uint32)
                rows_.append((g, True, b"".join(sids[i] for i in mine.tolist()), heads.tobytes(), b"".join(packed[owed[i] : owed[i + 1]].tobytes() for i in mine)))
            h, p, owner = h[~hot], p[~hot], owner[~hot]
            order = np.argsort(p, kind="stable")
            h, p, owner = h[order], p[order], owner[order]
            six = np.ascontiguousarray((h >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6])
            new = np.flatnonzero(np.concatenate(([True], (np.diff(p) != 0) | (np.diff(owner) != 0)))) if len(p) else np.empty(0, dtype=np.int64)
            lens = np.diff(np.append(new, len(p))).astype(np.uint32)
            cuts = np.searchsorted(p[new], np.arange(parts + 1)) if len(new) < parts else np.concatenate(([0], np.cumsum(np.bincount(p[new], minlength=parts))))
            ends = np.append(new, len(p))
            for g in np.flatnonzero(np.diff(cuts)).tolist():
                i, j = cuts[g], cuts[g + 1]
                rows_.append((g, False, sid[owner[new[i:j]]].tobytes(), lens[i:j].tobytes(), six[ends[i] : ends[j]].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows_, strict=True), _ROUTED, strict=True)], schema=_ROUTED)

        begin_task("jaccard")
        for batch in batches:
            seen: dict[bytes, np.ndarray] = {}
            held = 0
            for v in batch.column(1):
                h = shingles(v.as_py(), k)
                if len(h) and (sid := _set_id(h)) not in seen:
                    seen[sid] = h
                    held += len(h)
                    if held >= 1_000_000:
                        yield from flush(list(seen), list(seen.values()))
                        seen, held = {}, 0
            if seen:
                yield from flush(list(seen), list(seen.values()))

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the shingles dealt to this partition, those in two sets or more, by set."""
        begin_task("jaccard")
        sids, lens, blobs, place = [], [], [], []
        for batch in batches:
            heads = batch.column(1)
            if heads.true_count:
                yield batch.filter(heads)
            for p, s, m, b in zip(*(batch.filter(pa.compute.invert(heads)).column(c).to_pylist() for c in (0, 2, 3, 4)), strict=True):
                sids.append(np.frombuffer(s, dtype=np.int64))
                lens.append(np.frombuffer(m, dtype=np.uint32))
                blobs.append(b)
                place.append(np.full(len(sids[-1]), p, dtype=np.int64))
        if not sids:
            return
        sid, size, p = np.concatenate(sids), np.concatenate(lens).astype(np.int64), np.concatenate(place)
        six = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, 6)
        del blobs, sids, lens, place
        wide = np.zeros((len(six), 8), dtype=np.uint8)
        wide[:, :6] = six
        del six
        once = np.zeros(len(sid), dtype=bool)  # a set comes from each batch that has a copy of it; one counts
        order = np.lexsort((sid, p))
        once[order[np.concatenate(([True], (np.diff(sid[order]) != 0) | (np.diff(p[order]) != 0)))]] = True
        owner = np.repeat(np.arange(len(sid)), size)
        keep = once[owner]
        owner = owner[keep]
        keys = _key(wide.view(np.uint64).ravel()[keep] << np.uint64(16), p[owner])
        del wide
        order = np.argsort(keys, kind="stable")
        first = np.concatenate(([True], np.diff(keys[order]) != 0))
        counts = np.diff(np.append(np.flatnonzero(first), len(keys)))
        c = np.empty(len(keys), dtype=np.int64)
        c[order] = np.repeat(counts, counts)
        del order, first
        keys, owner, c = keys[c > 1], owner[c > 1], c[c > 1]
        home = sid[owner] % parts
        order = np.lexsort((owner, home))
        keys, owner, c, home = keys[order], owner[order], c[order], home[order]
        packed = _pack(keys, c)
        new = np.flatnonzero(np.concatenate(([True], np.diff(owner) != 0))) if len(owner) else np.empty(0, dtype=np.int64)
        ends = np.append(new, len(owner))
        lens_ = np.diff(ends).astype(np.uint32)
        cuts = np.searchsorted(home[new], np.arange(parts + 1))
        for g in np.flatnonzero(np.diff(cuts)).tolist():
            i, j = cuts[g], cuts[g + 1]
            row = (g, False, sid[owner[new[i:j]]].tobytes(), lens_[i:j].tobytes(), packed[ends[i] : ends[j]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ROUTED, strict=True)], schema=_ROUTED)

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets that share enough, with their shared shingles and the rare ones among the first."""
        begin_task("jaccard")
        sids, sizes, head_of, packed, lens, digests = [], [], [], [], [], []
        for batch in batches:
            for head, s, m, b in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3, 4)), strict=True):
                m = np.frombuffer(m, dtype=np.uint32).astype(np.int64)
                if head:
                    own = [s[at : at + 16] for at in range(0, len(s), 16)]
                    sid = _ids(own, clashing.value)
                    digests += own
                else:
                    sid = np.frombuffer(s, dtype=np.int64)
                sids.append(sid)
                packed.append(np.frombuffer(b, dtype=_PACKED))
                head_of.append(np.full(len(sid), head))
                sizes.append(m[::2] if head else np.zeros(len(sid), dtype=np.int64))
                lens.append(m[1::2] if head else m)
        if not sids:
            return
        sid, size, is_head, items, lens_ = (np.concatenate(x) for x in (sids, sizes, head_of, packed, lens))
        whole, at = np.unique(sid[is_head], return_index=True)
        n, digests = size[is_head][at], [digests[i] for i in at.tolist()]
        owner = np.repeat(np.searchsorted(whole, sid), lens_)
        order = np.lexsort((items["key"], owner))
        owner, items = owner[order], items[order]
        new = np.concatenate(([True], (np.diff(owner) != 0) | (np.diff(items["key"]) != 0))) if len(owner) else np.empty(0, dtype=bool)
        owner, items = owner[new], items[new]
        shared = np.bincount(owner, minlength=len(whole))
        ends = np.concatenate(([0], np.cumsum(shared)))
        out: list[tuple] = []
        for i in np.flatnonzero(shared * den >= n * num).tolist():
            mine = items[ends[i] : ends[i + 1]]
            first_few = int(n[i]) - -(-num * int(n[i]) // den) + 1 - (int(n[i]) - len(mine))
            rare = mine["key"][np.lexsort((mine["key"], mine["c"]))[: max(first_few, 0)]]
            out.append((digests[i], int(n[i]), mine["key"].tobytes(), rare.view(np.int64).tolist()))
            if len(out) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PROFILE, strict=True)], ["digest", "n", "keys", "rare"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _PROFILE, strict=True)], ["digest", "n", "keys", "rare"])

    routed = "p int, head boolean, sids binary, lens binary, blob binary"
    dealt = source.mapInArrow(deal, routed).repartitionById(parts, "p")
    shared = dealt.mapInArrow(share, routed).repartitionById(parts, "p")
    sets = materialize(shared.mapInArrow(profile, "digest binary, n long, keys binary, rare array<long>").withColumn("sid", F.monotonically_increasing_id()))

    rare = sets.select("sid", F.explode("rare").alias("r"))
    star = rare.groupBy("r").agg(F.min("sid").alias("b"), F.count("*").alias("many")).where("many > 1").select("r", "b")
    near = connected_components(rare.join(star, "r").where("sid <> b").select(F.col("sid").alias("a"), "b").distinct()).withColumnRenamed("node", "sid")
    cut = F.greatest(F.ceil(F.sum("n") / block), F.ceil(F.count("*") / piece)).cast("int")
    sizes = sets.select("sid", "n").join(near, "sid").groupBy("component").agg(cut.alias("cuts"), F.count("*").alias("members"))
    near = materialize(near.join(sizes, "component"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within each run of rows of one task; a row ends with its set, its size and keys, and what it is known to be joined to."""
        begin_task("jaccard")
        now, run = None, []
        for batch in batches:
            for *task, sid, n, blob, known in zip(*(batch.column(x).to_pylist() for x in range(batch.num_columns)), strict=True):
                if task != now:
                    if len(run) > 1:
                        yield _stars(run, num, den)
                    now, run = task, []
                run.append((sid, n, blob, known))
        if len(run) > 1:
            yield _stars(run, num, den)

    several = F.col("cuts") > 1
    pivot = several & (F.pmod(F.xxhash64("sid", F.lit(7)), F.col("members")) < pivots)
    pieces = near.withColumn("piece", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("cuts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("sid"), F.col("cuts")).cast("int")))))
    # Pieces of a component go to partitions in turn, so that none gets several of a large one by chance.
    tasks = pieces.join(sets.select("sid", "n", "keys"), "sid").select(F.pmod(F.xxhash64("component") + F.col("piece"), F.lit(parts)).cast("int").alias("p"), "component", "piece", "sid", "n", "keys", F.col("sid").alias("known"))
    tasks = tasks.repartitionById(parts, "p").sortWithinPartitions("component", "piece").drop("p")
    linked = connected_components(tasks.mapInArrow(verify, "a long, b long"))

    if not near.where(several).isEmpty():
        parted = near.where(several).select("sid").join(linked.withColumnRenamed("node", "sid"), "sid", "left").select("sid", F.coalesce("component", "sid").alias("known"))
        held = materialize(rare.join(parted, "sid"))
        by_label = held.groupBy("r", "known").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("y"))
        by_r = by_label.groupBy("r").agg(F.count("*").alias("labels"), F.max("m").alias("most"), F.max_by("known", F.struct("m", "known")).alias("major"), F.sum("m").alias("m"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).where("labels > 1")
        # Shingles of the same sets (those of a passage, say) decide the same pairs: one of them is enough.
        by_r = by_r.groupBy("m", "x", "y").agg(F.min_by(F.struct("r", "most", "major"), "r").alias("z")).select("z.*", "m")
        open_ = held.join(by_r, "r").withColumn("i", F.ceil(F.col("most") / piece).cast("int")).withColumn("j", F.ceil((F.col("m") - F.col("most")) / piece).cast("int"))
        at = F.expr("cast(pmod(xxhash64(sid), if(known = major, i, j)) as int)")
        open_ = open_.withColumn("at", at).withColumn("task", F.explode(F.expr("""
            if(known = major, transform(sequence(0, j - 1), x -> struct(0 as kind, at as i, x as j)),
               concat(transform(sequence(0, i - 1), x -> struct(0 as kind, x as i, at as j)),
                      transform(filter(sequence(0, j - 1), x -> x <> at), x -> struct(1 as kind, least(x, at) as i, greatest(x, at) as j))))""")))
        again = open_.select("r", "task.*", "sid", "known").join(sets.select("sid", "n", "keys"), "sid")
        again = again.select(F.pmod(F.xxhash64("r") + F.col("i") * F.lit(31) + F.col("j"), F.lit(parts)).cast("int").alias("p"), "r", "kind", "i", "j", "sid", "n", "keys", "known")
        again = again.repartitionById(parts, "p").sortWithinPartitions("r", "kind", "i", "j").drop("p")
        more = again.mapInArrow(verify, "a long, b long")
        linked = connected_components(more.union(linked.select(F.col("node").alias("a"), F.col("component").alias("b"))))

    names = sets.select("sid", "digest")
    named = linked.join(names.withColumnRenamed("sid", "node"), "node").join(names.toDF("component", "of"), "component").select("digest", "of")
    least = rows.where("digest is not null").groupBy("digest").agg(F.min("key").alias("least"))
    named = materialize(least.join(named, "digest", "left").withColumn("of", F.coalesce("of", "digest")))
    lowest = named.groupBy("of").agg(F.min("least").alias("lowest"))
    final = materialize(named.select("digest", "of").join(lowest, "of").select("digest", "of", F.col("lowest").alias("component_id")))
    out = rows.join(final, "digest", "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("digest").isNull(), F.col("key")).otherwise(F.col("component_id")).alias("component_id"), *[F.col(f"__c_{c}").alias(c) for c in carry or []], *([F.col("of").alias(group)] if group else []))


_PACKED = np.dtype([("key", "<u8"), ("c", "<u2")])
_PROFILE = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
_ROUTED = pa.schema([("p", pa.int32()), ("head", pa.bool_()), ("sids", pa.binary()), ("lens", pa.binary()), ("blob", pa.binary())])


def _key(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    """A shingle's name: the upper 48 bits of its hash, and the partition that the whole hash chose."""
    return (h >> np.uint64(16) << np.uint64(16)) | (p.astype(np.uint64) & np.uint64(0xFFFF))


def _ids(digests: list[bytes], clashing: frozenset[bytes]) -> np.ndarray:
    """64 bits of each digest that no other set has: the first half, or the second of those whose first half is another's too."""
    halves = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
    out = halves[:, 0].copy()
    if clashing:
        second = [i for i, d in enumerate(digests) if d in clashing]
        out[second] = halves[second, 1]
    return out


def _stars(run: list[tuple], num: int, den: int) -> pa.RecordBatch:
    """Each set with the first of its component, from ``(sid, n, keys, known)``."""
    root = link_group([np.frombuffer(b, dtype=np.uint64) for _, _, b, _ in run], np.array([n for _, n, _, _ in run]), num, den, np.array([x for *_, x in run]))
    pairs = [(run[i][0], run[r][0]) for i, r in enumerate(root.tolist()) if i != r]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])


def _pack(keys: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Keys with their counts; large counts are all alike, which only orders them by key."""
    out = np.empty(len(keys), dtype=_PACKED)
    out["key"], out["c"] = keys, np.minimum(c, 65535)
    return out


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ``documents``; see ``near_duplicates`` for nulls, short and repeated texts and empty tables."""
    return near_duplicates(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
gram AS MATERIALIZED (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM doc WHERE len(w) > 0)),
size AS MATERIALIZED (SELECT r, count(*) AS n FROM gram GROUP BY r),
both_have AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM gram a JOIN gram b USING (g) WHERE a.r <> b.r GROUP BY 1, 2),
pair AS MATERIALIZED (
  SELECT x, y FROM both_have JOIN size s ON s.r = x JOIN size t ON t.r = y WHERE 100 * k >= 80 * (s.n + t.n - k)),
reach(x, y) AS (
  SELECT r, r FROM doc UNION SELECT reach.x, pair.y FROM reach JOIN pair ON reach.y = pair.x)
SELECT doc.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM doc LEFT JOIN size USING (r) JOIN (SELECT x, min(d.doc_id) AS component_id FROM reach JOIN doc d ON d.r = reach.y GROUP BY x) c ON c.x = doc.r
"""
