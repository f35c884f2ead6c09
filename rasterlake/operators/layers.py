"""Building blocks of the networks as operators on tensors: a tensor is ``struct<c:int,h:int,w:int,v:array<double>>``, its values channel by channel, row by row.

What an image decides alone is NumPy on slices of Arrow batches and moves nothing; images of one size in a slice are worked on together. Batch normalisation needs moments over all images: each image gives its own count, mean and sum
of squares about it for every channel, and only those are shuffled. Convolved tensors, several times the input, are never written: a block is fitted depth by depth, each time from
its input through the layers whose moments are known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterlake.functions.once import settled
from rasterlake.operators import manifests

TENSOR = "struct<c:int,h:int,w:int,v:array<double>>"
_ARROW = pa.struct([("c", pa.int32()), ("h", pa.int32()), ("w", pa.int32()), ("v", pa.list_(pa.float64()))])
EPS = 1e-5


def tensor(channels: Column, h: Column, w: Column) -> Column:
    """A tensor from an array of flat channels; null channels give a null tensor."""
    return F.when(channels.isNotNull(), F.struct(F.size(channels).alias("c"), h.cast("int").alias("h"), w.cast("int").alias("w"), F.flatten(channels).alias("v")))


Step = tuple[list[str], Callable[..., np.ndarray]]


#: Values of all inputs that are worked on together at most, unless one image has more: a worker holds what is made of so many, however long its batches are.
TOGETHER = 1 << 16


def apply(df: DataFrame, outputs: dict[str | tuple[str, ...], Step], drop: list[str] | None = None, alone: bool = False) -> DataFrame:
    """Adds a tensor for each of ``outputs``: a function of the arrays of the columns named with it; for a tuple of names, one that gives as many. One narrow pass.

    Arrays are (images, channels, height, width), of images whose inputs have the same sizes; ``alone`` leaves the first axis out and takes one image at a time. Null where any input is;
    columns of ``drop`` go, and a column of the same name is replaced.
    """
    inputs = list(dict.fromkeys(c for names, _ in outputs.values() for c in names))
    new = [n for key in outputs for n in ((key,) if isinstance(key, str) else key)]
    steps = [([inputs.index(c) for c in names], f if isinstance(key, tuple) else _single(f), 1 if isinstance(key, str) else len(key)) for key, (names, f) in outputs.items()]
    stay = [c for c in df.columns if c not in {*(drop or []), *new}]
    sent = [*stay, *(c for c in inputs if c not in stay)]  # each once, even if it is an input and stays
    places = [sent.index(c) for c in inputs]

    def arrays(column: pa.StructArray) -> list[np.ndarray | None]:
        c, h, w = (column.field(k).to_pylist() for k in range(3))
        values = column.field(3)
        flat, at = values.values.to_numpy(zero_copy_only=False), values.offsets.to_numpy()
        ok = column.is_valid().to_pylist()
        return [flat[at[i] : at[i + 1]].reshape(c[i], h[i], w[i]) if ok[i] else None for i in range(len(column))]

    def worked(batch: pa.RecordBatch) -> pa.RecordBatch:
        given = [arrays(batch.column(k)) for k in places]
        made = []
        for at, f, many in steps:
            got: list = [(None,) * many] * batch.num_rows
            for rows, xs in _groups([given[k] for k in at], 1 if alone else TOGETHER):
                ys = [np.asarray(y, dtype=np.float64) for y in f(*((x[0] for x in xs) if alone else xs))]
                for n, row in enumerate(rows):
                    got[row] = ys if alone else [y[n] for y in ys]
            made += [_packed([row[k] for row in got]) for k in range(many)]
        every = pa.array(np.arange(batch.num_rows))
        kept = [batch.column(k).take(every) for k in range(len(stay))]  # copies: a slice would hold its whole batch while the next is read
        return pa.RecordBatch.from_arrays([*kept, *made], [*stay, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in _slices([batch.column(k) for k in places], TOGETHER):
                yield worked(batch.slice(at, n))
            del batch  # or it would be held while the next is read
        pa.default_memory_pool().release_unused()  # the worker stays for other tasks

    types = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in stay] + [f"`{c}` {TENSOR}" for c in new])
    return df.select(*[F.col(f"`{c}`") for c in sent]).mapInArrow(run, schema)


def _slices(columns: list[pa.StructArray], together: int) -> Iterator[tuple[int, int]]:
    """First row and length of runs of rows that hold ``together`` values in all columns at most, or are one row. No rows are one empty run."""
    sizes = np.sum([np.diff(c.field(3).offsets.to_numpy()) for c in columns], axis=0)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes) or not at:
        end = max(at + 1, int(np.searchsorted(ends, together + (ends[at - 1] if at else 0), "right")))
        yield at, end - at
        at = end


def _groups(columns: list[list[np.ndarray | None]], together: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Rows without nulls whose arrays have the same sizes, and their arrays stacked."""
    alike: dict[tuple, list[int]] = {}
    for row, xs in enumerate(zip(*columns, strict=True)):
        if not any(x is None for x in xs):
            alike.setdefault(tuple(x.shape for x in xs), []).append(row)
    for shapes, rows in alike.items():
        n = max(1, together // max(1, *(int(np.prod(s)) for s in shapes)))
        for at in range(0, len(rows), n):
            part = rows[at : at + n]
            yield part, [np.stack([c[r] for r in part]) for c in columns]


def _single(f: Callable[..., np.ndarray]) -> Callable[..., tuple]:
    return lambda *xs: (f(*xs),)


def _packed(got: list[np.ndarray | None]) -> pa.StructArray:
    sizes = [0 if g is None else g.size for g in got]
    flat = np.concatenate([np.empty(0), *[g.ravel() for g in got if g is not None]])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
    dims = [pa.array([0 if g is None else g.shape[k] for g in got], pa.int32()) for k in range(3)]
    return pa.StructArray.from_arrays([*dims, lists], fields=list(_ARROW), mask=pa.array([g is None for g in got]))


@dataclass(frozen=True)
class Conv:
    """Shape of a convolution: ``size``, ``padding`` and ``dilation`` by height and width."""

    out: int
    inp: int
    size: tuple[int, int] = (1, 1)
    padding: tuple[int, int] = (0, 0)
    dilation: int = 1
    stride: int = 1

    @property
    def weights(self) -> int:
        return self.out * self.inp * self.size[0] * self.size[1]


#: A convolution and its weights (out, in, height, width).
Layer = tuple[Conv, np.ndarray]


def square(out: int, inp: int, size: int = 3, dilation: int = 1, stride: int = 1) -> Conv:
    """A square convolution that keeps the size (at stride 1)."""
    pad = dilation * (size // 2)
    return Conv(out, inp, (size, size), (pad, pad), dilation, stride)


def read_weights(table: DataFrame, specs: dict[str, Conv]) -> dict[str, Layer]:
    """Layers with their weights from ``table(layer, o, i, y, x, w)``, in one job; missing ones are 0, other layers are not read.

    The shapes bound what comes to the driver: a place outside its layer, or given twice, is an error.
    """
    rows = table.select("layer", "o", "i", "y", "x", "w").where(F.col("layer").isin(*specs)).limit(sum(s.weights for s in specs.values()) + 1).collect()
    out, seen = {name: np.zeros((s.out, s.inp, *s.size)) for name, s in specs.items()}, set()
    for name, *at, w in rows:
        place = name, *at
        if place in seen or not all(0 <= v < n for v, n in zip(at, out[name].shape, strict=True)):
            raise ValueError(f"weight at {place} is given twice or outside {out[name].shape}")
        seen.add(place)
        out[name][tuple(at)] = w
    return {name: (s, out[name]) for name, s in specs.items()}


def correlate(x: np.ndarray, w: np.ndarray, spec: Conv, bias: np.ndarray | None = None) -> np.ndarray:
    """Correlation of all channels with each kernel, zeros outside: one matrix product a tap. Axes before the channels stay as they are."""
    (ph, pw), (kh, kw), d, s = spec.padding, spec.size, spec.dilation, spec.stride
    if x.shape[-3] != spec.inp:
        raise ValueError(f"{x.shape[-3]} channels where {spec.inp} are expected")
    p = np.pad(x, [(0, 0)] * (x.ndim - 2) + [(ph, ph), (pw, pw)])
    h, wd = (p.shape[-2] - d * (kh - 1) - 1) // s + 1, (p.shape[-1] - d * (kw - 1) - 1) // s + 1
    out = 0.0
    for i in range(kh):
        for j in range(kw):
            out = out + np.tensordot(p[..., i * d : i * d + (h - 1) * s + 1 : s, j * d : j * d + (wd - 1) * s + 1 : s], w[:, :, i, j], ((-3,), (1,)))
    out = np.moveaxis(out, -1, -3)
    return out if bias is None else out + bias[:, None, None]


def _partial(x: np.ndarray) -> np.ndarray:
    """Count, mean and sum of squared deviations of each channel."""
    flat = x.reshape(*x.shape[:-2], -1)
    m = flat.mean(axis=-1)
    return np.stack([np.full(m.shape, flat.shape[-1], float), m, ((flat - m[..., None]) ** 2).sum(axis=-1)], axis=-1)[..., None]


def moments(df: DataFrame, parts: tuple[str, ...], step: Step) -> dict[str, np.ndarray]:
    """Mean and variance (over all values) of each channel over all images of the tensors that ``step`` makes: by name in ``parts``, a row of two numbers a channel.

    Means are merged by their counts, and the sum of squares about the merged mean is that of the images plus that of their means, so nothing cancels. A row for
    each name and channel comes to the driver. Null tensors do not count; without any, there are no moments.
    """
    names = {f"__m{k}": name for k, name in enumerate(parts)}
    inputs, make = step
    own = apply(df, {tuple(names): (inputs, lambda *xs: tuple(map(_partial, make(*xs))))}, df.columns)
    of = "struct<name:string,channel:int,p:array<double>>"

    def each(m: str, name: str) -> Column:
        rows = F.transform(F.sequence(F.lit(0), F.col(f"{m}.c") - 1), lambda k: F.struct(F.lit(name).alias("name"), k.alias("channel"), F.slice(F.col(f"{m}.v"), k * 3 + 1, 3).alias("p")))
        return F.when(F.col(m).isNotNull(), rows).otherwise(F.array().cast(f"array<{of}>"))

    flat = own.select(F.explode_outer(F.concat(*[each(m, n) for m, n in names.items()])).alias("r")).where("r IS NOT NULL")
    number = lambda k: F.get("r.p", F.lit(k))
    rows = manifests.written(flat.select("r.name", "r.channel", number(0).alias("n"), number(1).alias("m"), number(2).alias("q")))
    means = rows.groupBy("name", "channel").agg(F.sum("n").alias("all"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    about = rows.join(F.broadcast(means), ["name", "channel"])  # a row for each channel
    found = about.groupBy("name", "channel").agg(F.first("mean").alias("mean"), (F.sum(F.expr("q + n * (m - mean) * (m - mean)")) / F.first("all")).alias("var")).collect()
    return {c: np.array([(r["mean"], r["var"]) for r in sorted(found, key=lambda r: r.channel) if r.name == c]) for c in parts}


def normaliser(stats: np.ndarray, gamma: np.ndarray | None = None, beta: np.ndarray | None = None, eps: float = EPS) -> Callable[[np.ndarray], np.ndarray]:
    """Batch normalisation by given moments (those of a batch, or running ones)."""
    if not len(stats):
        return lambda x: x
    scale = (1 if gamma is None else gamma) / np.sqrt(stats[:, 1] + eps)
    shift = (0 if beta is None else beta) - stats[:, 0] * scale
    return lambda x: x * scale[:, None, None] + shift[:, None, None]


#: What a node of a block is made of: its inputs, what is made of them, and the layer that convolves that and is normalised (None: neither).
Node = tuple[list[str], Callable[..., np.ndarray], Layer | None]
Stats = dict[str, np.ndarray]


def _sources(depths: list[dict[str, Node]]) -> list[str]:
    made = {name for depth in depths for name in depth}
    return list(dict.fromkeys(c for depth in depths for inputs, *_ in depth.values() for c in inputs if c not in made))


def _through(depths: list[dict[str, Node]], stats: Stats, wanted: tuple[str, ...]) -> Step:
    """The sources of a block and the function from them to the nodes ``wanted``, normalised where ``stats`` has moments; only what they need is worked out, and once."""
    nodes = {name: node for depth in depths for name, node in depth.items()}
    needed, todo = set(), list(wanted)
    while todo:
        name = todo.pop()
        if name in nodes and name not in needed:
            needed.add(name)
            todo += nodes[name][0]
    sources = [c for c in _sources(depths) if any(c in nodes[n][0] for n in needed)]
    after = {n: normaliser(stats[n]) for n in needed if n in stats}
    steps = [(name, *nodes[name]) for depth in depths for name in depth if name in needed]

    def run(*xs: np.ndarray) -> tuple[np.ndarray, ...]:
        env = dict(zip(sources, xs, strict=True))
        for name, inputs, make, layer in steps:
            x = make(*(env[c] for c in inputs))
            x = x if layer is None else correlate(x, layer[1], layer[0])
            env[name] = after[name](x) if name in after else x
        return tuple(env[name] for name in wanted)

    return sources, run


def fit(df: DataFrame, depths: list[dict[str, Node]]) -> Stats:
    """The moments of every layer of a block over all images of ``df``, one depth after another: a pass from the sources for each depth, which writes moments alone."""
    stats: Stats = {}
    rows = df.select(*_sources(depths))
    for k, depth in enumerate(depths):
        parts = tuple(name for name, (*_, layer) in depth.items() if layer is not None)
        if parts:
            stats |= moments(rows, parts, _through(depths[: k + 1], stats, parts))
    return stats


def block(df: DataFrame, depths: list[dict[str, Node]], outputs: list[str], stats: Stats | None = None) -> DataFrame:
    """Adds the nodes ``outputs`` of a block. Without ``stats``, moments are those of all images of ``df``, which is written once and read for each depth; with them (from ``fit``), all is narrow."""
    if stats is None:
        df = manifests.written(df)
        stats = fit(df, depths)
    return apply(df, {tuple(outputs): _through(depths, stats, tuple(outputs))})


def conv_norm(df: DataFrame, layers: dict[str, Node], stats: Stats | None = None) -> DataFrame:
    """Adds the normalised convolution of what each of ``layers`` makes of its inputs. There is no rectifier in it."""
    return block(df, [layers], list(layers), stats)


def same(x: np.ndarray) -> np.ndarray:
    return x


def concat(*xs: np.ndarray) -> np.ndarray:
    """Channels of all, one after another."""
    return np.concatenate(xs, axis=-3)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def receptive_specs(inp: int, out: int) -> dict[str, Conv]:
    """Layers of a receptive-field block: a point, and three branches whose reach is 3, 5 and 7 along rows, columns and (dilated) both."""
    specs = {"b0_0": Conv(out, inp), "res": Conv(out, inp), "cat": square(out, 4 * out)}
    for b, k in ((1, 3), (2, 5), (3, 7)):
        specs |= {f"b{b}_0": Conv(out, inp), f"b{b}_1": Conv(out, out, (1, k), (0, k // 2)), f"b{b}_2": Conv(out, out, (k, 1), (k // 2, 0)), f"b{b}_3": square(out, out, 3, k)}
    return specs


def receptive_field(df: DataFrame, column: str, out: str, layers: dict[str, Layer], stats: Stats | None = None) -> DataFrame:
    """Adds ``out``: the rectified sum of the joined branches and a point convolution of ``column`` (see ``receptive_specs``), each layer normalised over all images."""
    return block(df, receptive_nodes(column, out, layers), [out], stats)


def receptive_nodes(column: str, out: str, layers: dict[str, Layer]) -> list[dict[str, Node]]:
    """The depths of a receptive-field block, for ``fit`` and ``block``."""
    first = {n: ([column], same, layers[n]) for n in ("b0_0", "res", "b1_0", "b2_0", "b3_0")}
    along = [{f"b{b}_{k}": ([f"b{b}_{k - 1}"], same, layers[f"b{b}_{k}"]) for b in (1, 2, 3)} for k in (1, 2, 3)]
    cat = {"cat": (["b0_0", "b1_3", "b2_3", "b3_3"], concat, layers["cat"])}
    return [first, *along, cat, {out: (["cat", "res"], lambda a, b: np.maximum(a + b, 0), None)}]


def pooled(x: np.ndarray, size: int, stride: int, padding: int = 0, how: str = "max", ceil: bool = False, count_outside: bool = True) -> np.ndarray:
    """Strided windows of each channel: their maximum, or mean. Outside is nothing to a maximum and zeros to a mean (which are counted if ``count_outside``).

    ``ceil`` adds a window that starts inside and ends beyond the edge; what lies beyond the padding never counts.
    """
    h, w = x.shape[-2:]
    count = [max(0, -((size - n - 2 * padding) // stride) if ceil else (n + 2 * padding - size) // stride) + 1 for n in (h, w)]
    if ceil:  # the last window must start inside
        count = [k - ((k - 1) * stride >= n + padding) for k, n in zip(count, (h, w), strict=True)]
    reach = [max((k - 1) * stride + size, n + 2 * padding) for k, n in zip(count, (h, w), strict=True)]
    p = np.full((*x.shape[:-2], *reach), -np.inf if how == "max" else 0.0)
    p[..., padding : padding + h, padding : padding + w] = x
    inside = np.zeros(reach)
    inside[padding : padding + h, padding : padding + w] = 1
    if count_outside:
        inside[: h + 2 * padding, : w + 2 * padding] = 1
    parts = [(..., *(slice(o, o + (k - 1) * stride + 1, stride) for o, k in zip(at, count, strict=True))) for at in np.ndindex(size, size)]
    if how == "max":
        return np.maximum.reduce([p[s] for s in parts])
    return np.add.reduce([p[s] for s in parts]) / np.add.reduce([inside[s] for s in parts])


def pool(df: DataFrame, column: str, out: str, size: int, stride: int, padding: int = 0, how: str = "max", ceil: bool = False, count_outside: bool = True) -> DataFrame:
    """Adds the pooled tensor; narrow."""
    return apply(df, {out: ([column], lambda x: pooled(x, size, stride, padding, how, ceil, count_outside))})


def pyramid(df: DataFrame, column: str, outputs: list[str], size: int = 2, stride: int = 2, padding: int = 0, how: str = "max") -> DataFrame:
    """Adds a tensor for each of ``outputs``: ``column`` pooled once, twice and so on. One narrow pass, as each further one in a stage takes a Python worker more for each task."""

    def levels(x: np.ndarray) -> tuple[np.ndarray, ...]:
        out = []
        for _ in outputs:
            x = pooled(x, size, stride, padding, how)
            out.append(x)
        return tuple(out)

    return apply(df, {tuple(outputs): ([column], levels)})


def resized(x: np.ndarray, height: int, width: int, corners: bool = True) -> np.ndarray:
    """Bilinear resize of each channel, corners on corners or not (then a smaller size takes the two nearest pixels, without averaging the rest)."""

    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i = np.arange(m)
        at = i * (n - 1) / max(m - 1, 1) if corners else np.clip((i + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    (y0, y1, fy), (x0, x1, fx) = axis(x.shape[-2], height), axis(x.shape[-1], width)
    rows = x[..., y0, :] * (1 - fy)[:, None] + x[..., y1, :] * fy[:, None]
    return rows[..., x0] * (1 - fx) + rows[..., x1] * fx


def upsampled(x: np.ndarray, factor: int = 2, corners: bool = True) -> np.ndarray:
    """Growth of each channel by a factor."""
    return resized(x, factor * x.shape[-2], factor * x.shape[-1], corners)


#: The numbers of groups that the attention takes.
GROUPS = (1, 2, 4, 8, 16, 32)


def interleaved(x: np.ndarray, y: np.ndarray, groups: int) -> np.ndarray:
    """Groups of the channels of ``x``, each followed by the guidance ``y``."""
    if groups not in GROUPS or x.shape[-3] % groups:
        raise ValueError(f"{groups} groups of {x.shape[-3]} channels are not supported")
    return concat(*(part for chunk in np.split(x, groups, axis=-3) for part in (chunk, y)))


def attend(x: np.ndarray, y: np.ndarray, groups: int, mix: Layer, mix_bias: np.ndarray, score: Layer, score_bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One group-reversal attention: features refined by the rectified convolution of ``interleaved``, then guidance refined by a score of them."""
    x = x + np.maximum(correlate(interleaved(x, y, groups), mix[1], mix[0], mix_bias), 0)
    return x, y + correlate(x, score[1], score[0], score_bias)


def attention_specs(channels: int, groups: int) -> tuple[Conv, Conv]:
    return square(channels, channels + groups), square(1, channels)


#: Groups, mixing layer and bias, scoring layer and bias of one attention.
Attention = tuple[int, Layer, np.ndarray, Layer, np.ndarray]


def _checked(blocks: list[Attention]) -> list[Attention]:
    for groups, *_ in blocks:
        if groups not in GROUPS:
            raise ValueError(f"{groups} groups are not supported")
    return blocks


def _reversed(x: np.ndarray, y: np.ndarray, blocks: list[Attention]) -> np.ndarray:
    y = 1 - sigmoid(y)
    for groups, *more in blocks:
        x, y = attend(x, y, groups, *more)
    return y


def reverse_stage(df: DataFrame, features: str, guidance: str, out: str, blocks: list[Attention]) -> DataFrame:
    """Adds ``out``: the guidance after ``1 - sigmoid`` of it went through the attention ``blocks`` one after another.

    There is no normalisation in the blocks, so all is narrow. Other numbers of groups than ``GROUPS`` are an error.
    """
    blocks = _checked(blocks)
    return apply(df, {out: ([features, guidance], lambda x, y: _reversed(x, y, blocks))})


def guided_cascade(df: DataFrame, levels: list[str], map_: str, outputs: list[str], stages: list[list[Attention]], shrink: int = 4) -> DataFrame:
    """Adds the maps that a coarse map becomes on its way up through ``levels`` of features, which double in size from first to last; one of ``outputs`` for each level.

    The map is resized to ``1/shrink`` of its size, which must be that of the first level. At each level it is refined by a reverse stage, added to what came in, and
    grown twice for the next. Corners are not on corners. Narrow.
    """
    stages = [_checked(blocks) for blocks in stages]

    def climb(y: np.ndarray, *xs: np.ndarray) -> tuple[np.ndarray, ...]:
        y, out = resized(y, y.shape[-2] // shrink, y.shape[-1] // shrink, False), []
        for x, blocks in zip(xs, stages, strict=True):
            y = upsampled(y, 2, False) if out else y
            y = y + _reversed(x, y, blocks)
            out.append(y)
        return tuple(out)

    return apply(df, {tuple(outputs): ([map_, *levels], climb)})


def rectified(x: np.ndarray) -> np.ndarray:
    return np.maximum(x, 0)


def bottleneck_specs(inp: int, planes: int, out: int, stride: int = 1) -> dict[str, Conv]:
    """Layers of a bottleneck: a point, a square at ``stride``, a point, and a point for what is added."""
    return {"in": Conv(planes, inp), "mid": square(planes, planes, stride=stride), "out": Conv(out, planes), "skip": Conv(out, inp, stride=stride)}


def bottleneck(df: DataFrame, column: str, out: str, layers: dict[str, Layer], stats: Stats | None = None) -> DataFrame:
    """Adds ``out``: the rectified sum of three layers (rectified between them) and of ``column``, through its own layer if ``layers`` has one."""
    chain = [{"in": ([column], same, layers["in"])}, {"mid": (["in"], rectified, layers["mid"])}, {"out": (["mid"], rectified, layers["out"])}]
    skip = "skip" if "skip" in layers else column
    if skip == "skip":
        chain[0]["skip"] = ([column], same, layers["skip"])
    return block(df, [*chain, {out: (["out", skip], lambda a, b: np.maximum(a + b, 0), None)}], [out], stats)


def split_specs(inp: int, width: int, out: int, stride: int = 1, scale: int = 4) -> dict[str, Conv]:
    """Layers of a split block: a point to ``scale`` groups of ``width`` channels, a square for each group but the last, a point, and a point for what is added."""
    return {"in": Conv(width * scale, inp), **{f"s{k}": square(width, width, stride=stride) for k in range(scale - 1)}, "out": Conv(out, width * scale), "skip": Conv(out, inp)}


def split_block(df: DataFrame, column: str, out: str, layers: dict[str, Layer], stats: Stats | None = None) -> DataFrame:
    """Adds ``out`` of a split residual block: groups of channels go through squares, each but the first with the result of the one before added, and are joined again.

    With a ``skip`` layer it is the first of a stage: groups go on their own, the last is averaged over 3 by 3, and what is added is averaged (at the stride) and
    convolved. Without, the last group is joined as it is, and ``column`` is added.
    """
    first = "skip" in layers
    squares = sorted(n for n in layers if n[0] == "s" and n[1:].isdigit())
    width, stride = layers["s0"][0].inp, layers["s0"][0].stride
    part = lambda a, k: rectified(a[..., k * width : (k + 1) * width, :, :])

    def take(k: int) -> Node:
        if k == 0 or first:
            return ["in"], lambda a: part(a, k), layers[f"s{k}"]
        return [f"s{k - 1}", "in"], lambda p, a: rectified(p) + part(a, k), layers[f"s{k}"]

    def join(a: np.ndarray, *done: np.ndarray) -> np.ndarray:
        last = part(a, len(squares))
        return concat(*map(rectified, done), pooled(last, 3, stride, 1, "mean") if first else last)

    depths: list[dict[str, Node]] = [{"in": ([column], same, layers["in"])}]
    if first:
        depths[0]["skip"] = ([column], lambda x: pooled(x, stride, stride, 0, "mean", True, False), layers["skip"])
        depths.append({n: take(k) for k, n in enumerate(squares)})
    else:
        depths += [{n: take(k)} for k, n in enumerate(squares)]
    depths += [{"out": (["in", *squares], join, layers["out"])}, {out: (["out", "skip" if first else column], lambda a, b: np.maximum(a + b, 0), None)}]
    return block(df, depths, [out], stats)


def decoder_specs(channels: int, search: bool = False) -> dict[str, Conv]:
    """Layers of a decoder over a pyramid of three resolutions; the search form joins a fourth tensor of the finest one."""
    c, wide = channels, (4 if search else 3) * channels
    return {
        **{f"up{k}": square(c, c) for k in (1, 2, 3, 4)}, "up5": square(2 * c, 2 * c), "cat2": square(2 * c, 2 * c),
        "cat3": square(wide, wide), "last": square(wide, wide), "out": Conv(1, wide),
    }


def decode(df: DataFrame, coarse: str, middle: str, fine: str, out: str, layers: dict[str, Layer], bias: np.ndarray, neighbours: bool = False, extra: str | None = None, stats: Stats | None = None) -> DataFrame:
    """Adds ``out``: the map of a decoder whose inputs double in size from ``coarse`` to ``fine``: each level multiplied by what grows from below, then joined and convolved.

    The fine level is multiplied by the coarse one grown twice or, between ``neighbours``, by the refined middle one grown once. ``extra`` is joined at the finest level
    (``decoder_specs(search=True)``). Every layer but the last is normalised over all images.
    """
    return block(df, decoder_nodes(coarse, middle, fine, out, layers, bias, neighbours, extra), [out], stats)


def decoder_nodes(coarse: str, middle: str, fine: str, out: str, layers: dict[str, Layer], bias: np.ndarray, neighbours: bool = False, extra: str | None = None) -> list[dict[str, Node]]:
    """The depths of a decoder, for ``fit`` and ``block``."""
    layer = lambda name, inputs, make: {name: (inputs, make, layers[name])}
    below = layer("up2", ["mid"], upsampled) if neighbours else layer("up2", [coarse], lambda x: upsampled(upsampled(x)))
    spec, w = layers["out"]
    return [
        {**layer("up1", [coarse], upsampled), **layer("up3", [middle], upsampled), **layer("up4", [coarse], upsampled), **({} if neighbours else below)},
        {"mid": (["up1", middle], np.multiply, None), **(below if neighbours else {}), **layer("cat2", ["mid", "up4"], concat)},
        {"top": (["up2", "up3", fine], lambda a, b, x: a * b * x, None), **layer("up5", ["cat2"], upsampled)},
        layer("cat3", ["top", "up5", *([extra] if extra else [])], concat),
        layer("last", ["cat3"], same),
        {out: (["last"], lambda x: correlate(x, w, spec, bias), None)},
    ]


def uniform(key: Column, seed: int, what: str) -> Column:
    """A number from 0 to below 1 that key, seed and purpose decide: the same on every run and partitioning; a null key counts as empty."""
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.lit(str(seed)), F.lit(what)).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def autocontrast(x: np.ndarray) -> np.ndarray:
    """Each channel stretched to 0..1; one of a single value is only held within 0..1."""
    low, high = (f(axis=(1, 2), keepdims=True) for f in (x.min, x.max))
    flat = high == low
    return np.clip((x - np.where(flat, 0, low)) / np.where(flat, 1, high - low), 0, 1)


def blur3(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian of three by three with ``sigma``, edges mirrored without being repeated (an edge of one pixel is itself)."""
    side = np.exp(-0.5 / sigma**2) / (1 + 2 * np.exp(-0.5 / sigma**2))
    for axis in (1, 2):
        wide = np.pad(x, [(0, 0) if k != axis else (1, 1) for k in range(3)], mode="reflect" if x.shape[axis] > 1 else "edge")
        n = x.shape[axis]
        a, b, c = (np.take(wide, range(t, t + n), axis) for t in range(3))
        x = side * (a + c) + (1 - 2 * side) * b
    return x


def augment(df: DataFrame, column: str, weak: str, strong: str, key: str, seed: int, flip: float = 0.5, contrast: float = 0.5, sigma: tuple[float, float] = (0.1, 1.5)) -> DataFrame:
    """Adds two views of a normalised tensor: ``weak``, mirrored or not, and ``strong``, which is that, stretched to 0..1 by channel or not, and blurred.

    Whether and how much is drawn from a hash of ``key`` and ``seed``. Both views share the mirror. Narrow; null tensors give nulls.
    """
    draws = F.array(uniform(F.col(key), seed, "flip"), uniform(F.col(key), seed, "contrast"), F.lit(sigma[0]) + F.lit(sigma[1] - sigma[0]) * uniform(F.col(key), seed, "sigma"))
    drawn = df.withColumn("__draws", tensor(F.array(draws), F.lit(1), F.lit(3)))
    turned = lambda x, d: x[:, :, ::-1] if d[0, 0, 0] > 1 - flip else x

    def view(x: np.ndarray, d: np.ndarray) -> np.ndarray:
        x = turned(x, d)
        return blur3(autocontrast(x) if d[0, 0, 1] < contrast else x, d[0, 0, 2])

    return apply(settled(drawn), {weak: ([column, "__draws"], turned), strong: ([column, "__draws"], view)}, ["__draws"], alone=True)


def remap(have: DataFrame, want: DataFrame, key: str, tags: tuple[str, ...] = ("_1", "_2")) -> DataFrame:
    """Every key of ``want`` beside the key of ``have`` that fills it: the same, else without the first of ``tags`` that it holds, at that tag's first place and no further than its second.

    Gives ``key``, ``source`` and the other columns of ``have``; reading a key that stays unmatched is an error. Keys of ``want`` count once; repeated keys of ``have`` are an error.
    """
    def without(tag: str) -> Column:
        parts = F.split(F.col(key), tag, -1)
        return F.concat(F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))

    other = F.lit(None).cast("string")
    for tag in reversed(tags):
        other = F.when(F.contains(F.col(key), F.lit(tag)), without(tag)).otherwise(other)
    names = have.groupBy(key).agg(F.count("*").alias("__n"))
    once = names.select(F.col(key).alias("__name"), F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("given twice: "), F.col(key)))).otherwise(F.lit(True)).cast("boolean").alias("__is"))
    wanted = want.select(key).distinct().withColumn("__other", other)
    exact = wanted.join(once, F.col(key) == F.col("__name"), "left").withColumn("__exact", F.col("__is")).drop("__name", "__is")
    both = exact.join(once, F.col("__other") == F.col("__name"), "left")
    source = F.when(F.col("__exact"), F.col(key)).when(F.col("__is"), F.col("__other")).otherwise(F.raise_error(F.concat(F.lit("no weights for "), F.col(key))))
    chosen = both.select(key, source.alias("source"))
    return chosen.join(have.withColumnRenamed(key, "__have"), F.col("source") == F.col("__have")).drop("__have")
