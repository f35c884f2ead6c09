"""Benchmark decontamination with generalised suffix automata of the test items.

Items are normalised to words and inserted into automata of bounded size, which are built by tasks and written once,
as flat arrays, to the shared folder. The words of a document are streamed through them; an automaton keeps the length
of the longest suffix read so far that some item contains. A word is *hit* where that length reaches a whole window of
an item. Documents are read in one narrow pass, however many items there are.
"""

from __future__ import annotations

import io
import re
import uuid
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm.common import begin_task, holds, materialize, shared_dir, table

#: Fixed values of the contract: words after lower-casing A-Z are runs of 0-9, a-z and everything beyond ASCII.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split() if text else []


class ItemAutomaton:
    """Generalised suffix automaton over the words of items, in flat arrays.

    A window is ``window`` consecutive words of an item, or all of a shorter one. Words are numbered by their place in
    ``vocab`` (the words with blanks between), from one. A state is four integers (``link``, ``length``; ``anchor``, the state of the window that
    is a suffix of what the state holds; ``short_at``, the nearest state along the links in which a short item ends), and its
    transitions are a run of ``edge_key`` (state and word) and ``edge_to``. There are at most two states and three
    transitions for each word of the items. ``held`` and ``held_items`` list, for states that hold a whole window or short item, its items.
    """

    FIELDS = ("vocab", "link", "length", "anchor", "short_at", "edge_key", "edge_to", "held", "held_size", "held_item", "pairs")

    def __init__(self, window: int, names: list[str], arrays: dict[str, np.ndarray]):
        self.window, self.names, self.arrays = window, names, arrays
        for name, value in arrays.items():
            setattr(self, name, value)
        self.number = {w: k for k, w in enumerate(arrays["vocab"].tobytes().split(), 1)}
        self._key = array("q", arrays["edge_key"].astype(np.int64).tobytes())
        self._to, self._link, self._length, self._anchor, self._short = (array("i", arrays[c].astype(np.int32).tobytes()) for c in ("edge_to", "link", "length", "anchor", "short_at"))
        self.of_state: dict[int, list[tuple[int, int]]] = {}
        for s, size, item in zip(*(arrays[c].tolist() for c in ("held", "held_size", "held_item")), strict=True):
            self.of_state.setdefault(s, []).append((size, item))
        self.least = int(arrays["held_size"].min()) if len(arrays["held_size"]) else window

    @classmethod
    def build(cls, items: list[tuple[str, list[bytes]]], window: int) -> ItemAutomaton:
        """The automaton of pairs of id and word list; items without words are left out."""
        items = [(i, ws) for i, ws in items if ws]
        names = sorted({i for i, _ in items})
        number = {i: k for k, i in enumerate(names)}
        vocab = sorted({w for _, ws in items for w in ws})
        of_word = {w: k for k, w in enumerate(vocab, 1)}
        texts = [(number[i], [of_word[w] for w in ws]) for i, ws in items]
        grow = _Growing()
        for _, ids in texts:
            last = 0
            for c in ids:
                last = grow.extend(last, c)
        nxt, link, length = grow.next, grow.link, grow.length
        n = len(nxt)
        by_length = sorted(range(n), key=length.__getitem__)
        anchor = [-1] * n
        for s in by_length:
            if length[s] >= window:
                anchor[s] = anchor[link[s]] if length[link[s]] >= window else s
        held: set[tuple[int, int, int]] = set()
        for item, ids in texts:
            s = 0
            for depth, c in enumerate(ids, 1):
                s = nxt[s][c]
                if depth >= window:
                    held.add((anchor[s], window, item))
            if len(ids) < window:
                held.add((s, len(ids), item))
        short = {s for s, size, _ in held if size < window}
        short_at = [-1] * n
        for s in by_length:
            short_at[s] = s if s in short else short_at[link[s]] if s else -1
        edges = np.array(sorted((s << 32 | c, t) for s, out in enumerate(nxt) for c, t in out.items()), dtype=np.int64).reshape(-1, 2)
        triples = np.array(sorted(held), dtype=np.int64).reshape(-1, 3)
        pairs = np.unique(np.concatenate([np.empty(0, dtype=np.int64), *(np.array(ids[:-1], dtype=np.int64) << 32 | np.array(ids[1:], dtype=np.int64) for _, ids in texts if len(ids) > 1)]))
        small = [np.array(x, dtype=np.int32) for x in (link, length, anchor, short_at)]
        return cls(window, names, dict(zip(cls.FIELDS, [np.frombuffer(b" ".join(vocab), dtype=np.uint8), *small, edges[:, 0], edges[:, 1].astype(np.int32), *(triples[:, k].astype(np.int32) for k in range(3)), pairs], strict=True)))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, window=np.array(self.window), names=np.frombuffer("\0".join(self.names).encode("utf-8", "surrogatepass"), dtype=np.uint8), **self.arrays)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> ItemAutomaton:
        with np.load(io.BytesIO(raw)) as z:
            arrays = {c: z[c] for c in cls.FIELDS}
            names = z["names"].tobytes().decode("utf-8", "surrogatepass").split("\0") if len(arrays["held"]) else []
            return cls(int(z["window"]), names, arrays)

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans (half-open, in words, disjoint, in order) of a text given by ``words``, and the items whose windows occur."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        if not ws or not self.number:
            return spans, set()
        get = self.number.get
        ids = np.array([get(w, 0) for w in ws], dtype=np.int64)
        # Unknown words, and two words side by side that no item has side by side, part the text: no window reaches over them.
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (ids > 0).view(np.int8), [0]))))
        long = edge.reshape(-1, 2)[edge[1::2] - edge[::2] >= self.least]
        if not len(long):
            return spans, set()
        at = np.concatenate([np.arange(a, b) for a, b in long.tolist()])
        both = ids[at[:-1]] << 32 | ids[at[1:]]
        joined = self.pairs[np.minimum(np.searchsorted(self.pairs, both), len(self.pairs) - 1)] == both if len(self.pairs) else np.zeros(len(both), dtype=bool)
        first = np.flatnonzero(np.concatenate(([True], ~joined | (np.diff(at) != 1))))
        sizes = np.diff(np.append(first, len(at)))
        keep = sizes >= self.least
        starts, ends = at[first[keep]], at[first[keep]] + sizes[keep]
        key, to, link, length, anchors, shorts, of_state, window = self._key, self._to, self._link, self._length, self._anchor, self._short, self.of_state, self.window
        last = len(key) - 1
        for begin, end in zip(starts.tolist(), ends.tolist(), strict=True):
            state = depth = 0
            for at, c in enumerate(ids[begin:end].tolist(), begin):
                want = state << 32 | c
                e = bisect_left(key, want, 0, last)
                while key[e] != want and state:
                    state = link[state]
                    depth = length[state]
                    want = state << 32 | c
                    e = bisect_left(key, want, 0, last)
                if key[e] == want:
                    state = to[e]
                    depth += 1
                low = at + 1
                if depth >= window:
                    found.update(item for _, item in of_state[anchors[state]])
                    low = at + 1 - window
                s = shorts[state]
                while s > 0:
                    for size, item in of_state[s]:
                        if size <= depth and size < window:
                            found.add(item)
                            low = min(low, at + 1 - size)
                    s = shorts[link[s]]
                if low <= at:
                    while spans and spans[-1][1] >= low:
                        low = min(low, spans.pop()[0])
                    spans.append((low, at + 1))
        return spans, {self.names[i] for i in found}


class _Growing:
    """Online construction of a generalised suffix automaton; a transition that an earlier item made is used again."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy


def build_automata(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = 13, shard_words: int = 250_000) -> DataFrame:
    """``(shard, path, size)``: automata of ``benchmark``, each built by one task from about ``shard_words`` item words and written to the shared folder.

    Items are dealt by a hash of their pieces: one that is longer than a tenth of a shard is cut into pieces that overlap by
    ``window - 1`` words, which loses no window. Null ids become an empty string; items without words are left out.
    """
    spark = benchmark.sparkSession
    folder = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    longest = max(shard_words // 10, 2 * window)
    source = benchmark.select(F.coalesce(benchmark[item_id].cast("string"), F.lit("")).alias("i"), benchmark[text].alias("t"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ws = words(t.as_py())
                parts = [ws[at : at + longest + window - 1] for at in range(0, max(len(ws) - window + 1, 1), longest)] if ws else []
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(parts), pa.string()), pa.array([b" ".join(p) for p in parts], pa.binary()), pa.array([len(p) for p in parts], pa.int64())], ["i", "ws", "n"])

    pieces = materialize(source.mapInArrow(cut, "i string, ws binary, n long"))
    shards = max(1, ceil((pieces.agg(F.sum("n")).first()[0] or 0) / shard_words))
    dealt = pieces.distinct().repartitionById(shards, F.pmod(F.xxhash64("i", "ws"), F.lit(shards)).cast("int"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = [(i, ws.split()) for batch in batches for i, ws in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        if not items:
            return
        from pyspark import TaskContext

        raw = ItemAutomaton.build(items, window).dump()
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.npz"  # an attempt of a task has a file of its own
        disk, at = fs.FileSystem.from_uri(folder)
        disk.create_dir(at)
        with disk.open_output_stream(f"{at}/{name}") as f:
            f.write(raw)
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([len(raw)], pa.int64())], ["path", "size"])

    return materialize(dealt.select("i", "ws").mapInArrow(build, "path string, size long"))


_LOADED: dict[str, ItemAutomaton] = {}
holds("decontaminate", _LOADED.clear)


def _automaton(path: str, held: int) -> ItemAutomaton:
    """An automaton from the shared folder; a worker keeps ``held`` of them."""
    if path not in _LOADED:
        while len(_LOADED) >= held:
            _LOADED.pop(next(iter(_LOADED)))
        disk, at = fs.FileSystem.from_uri(path)
        with disk.open_input_stream(at) as f:
            _LOADED[path] = ItemAutomaton.load(f.read())
    return _LOADED[path]


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13,
    coverage: tuple[int, int] = (1, 20), cut: bool = False, keep: list[str] | None = None, block_words: int = 250_000, held: int = 8,
) -> DataFrame:
    """Find benchmark windows in whole texts.

    Adds ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``spans`` (array of word ranges),
    ``items`` (ids, sorted as strings), ``contaminated`` (at least one hit and at least ``coverage`` of the
    words) and, if ``cut``, ``clean_text`` (the text without its hit spans). Null or empty texts have no words
    and are clean. Repeated rows each give a row, input columns with the names of outputs are dropped, an empty
    benchmark or table is fine. Items with fewer words than ``window`` count as one window.

    One narrow pass over the documents, whatever the number of items: a batch of documents is streamed through one
    automaton of ``block_words`` item words after another. A worker holds ``held`` of those at a time and reads the others
    from the shared folder again for each batch; only their paths are sent to the tasks.
    """
    new = ["n_words", "n_hit", "spans", "items", "contaminated", *(["clean_text"] if cut else [])]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    source = docs.select(*kept, docs[text].alias("__text"))
    paths = sorted(r.path for r in build_automata(benchmark, item_id, item_text, window, block_words).select("path").collect())  # a path for each shard
    fields = [f for f in source.schema.fields if f.name != "__text"]
    span_type = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    out_types = [("n_words", "long", pa.int64()), ("n_hit", "long", pa.int64()), ("spans", "array<struct<begin:int,end:int>>", span_type), ("items", "array<string>", pa.list_(pa.string())), *([("clean_text", "string", pa.string())] if cut else [])]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"{c} {t}" for c, t, _ in out_types])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task("decontaminate")
        for batch in batches:
            # Long texts go in smaller batches, so that what a task holds is bounded by one text and some MB.
            sizes = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False)) // 16_000_000
            cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
            for begin, end in zip(cuts, cuts[1:], strict=False):
                if begin < end:
                    yield scan_batch(batch.slice(begin, end - begin))

    def scan_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.num_columns - 1)
        read = [words(t.as_py()) for t in texts]
        spans: list[list[tuple[int, int]]] = [[] for _ in read]
        found: list[set[str]] = [set() for _ in read]
        for path in paths:
            auto = _automaton(path, held)
            for k, ws in enumerate(read):
                here, items = auto.scan(ws)
                if here:
                    spans[k] = merge_spans(spans[k], here)
                    found[k] |= items
        columns = {
            "n_words": [len(ws) for ws in read], "n_hit": [sum(b - a for a, b in s) for s in spans], "spans": [[{"begin": a, "end": b} for a, b in s] for s in spans],
            "items": [sorted(f) for f in found], "clean_text": [cut_spans(t.as_py(), s) for t, s in zip(texts, spans, strict=True)] if cut else [],
        }
        return pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(columns[c], t) for c, _, t in out_types], [f.name for f in fields] + [c for c, _, _ in out_types])

    part, whole = coverage
    flagged = source.mapInArrow(run, schema).withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * whole >= F.col("n_words") * part))
    return flagged.select(*kept, *new)


def merge_spans(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of two lists of spans; what overlaps or touches becomes one."""
    if not a:
        return b
    out: list[tuple[int, int]] = []
    for begin, end in sorted(a + b):
        if out and out[-1][1] >= begin:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def cut_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without the words of ``spans`` and what stands between them."""
    if not spans or text is None:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    out, done = [], 0
    for begin, end in spans:
        out.append(text[done : at[begin][0]])
        done = at[end - 1][1]
    return "".join([*out, text[done:]])


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all ``benchmark`` windows in all ``documents``; see ``decontaminate`` for nulls, repeated rows and empty tables."""
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


OP6_SQL = r"""
WITH item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, row_number() OVER () AS k,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT DISTINCT m FROM win),
gram AS (
  SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT r, w, m, unnest(range(1, greatest(len(w) - m + 2, 1))) AS i FROM doc, sizes)),
hit AS (SELECT r, gram.i, gram.m, item_id FROM gram JOIN win USING (m, g)),
word AS (SELECT DISTINCT r, unnest(range(i, i + m)) AS at FROM (SELECT DISTINCT r, i, m FROM hit)),
n AS (SELECT r, count(*) AS n_hit FROM word GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN n USING (r) LEFT JOIN ids USING (r)
"""
